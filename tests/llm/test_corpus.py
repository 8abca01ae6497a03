"""Archives, mixtures, test items and transcripts."""

import gzip
import itertools
import random
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexloom.llm import decontaminate, mixing, transcripts, warc
from tests.llm.fixtures import awkward_texts

# --- archives ----------------------------------------------------------------


def pages_of(spark):
    rows = [
        (5, "http://www.a.com/x?b=2&a=1#f", "<p>é</p>"),
        (3, "https://a.com:8080/y", "<p>é</p>"),
        (9, None, None),
        (7, "", ""),
        (2, "not a url\r\nat all", "x" * 300_000),
        (4, "http://[broken", "line\r\n\r\nline"),
        (None, "http://a.com/x?b=2&a=1", "<p>é</p>"),
        (8, "http://b.org/", "same"),
        (8, "http://b.org/", "same"),
        *[(100 + n, "http://hot.net/", f"v{n % 40}") for n in range(120)],
    ]
    return rows, spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as first", "'d' as digest")


@pytest.mark.parametrize("least", [0, 5])
def test_archives_round_trip(spark, least, monkeypatch):
    rows, pages = pages_of(spark)
    folder = warc.archive_folder(spark)
    parts = warc.build_index(warc.write_archives(pages, folder, least), folder)
    expected = []
    groups = defaultdict(list)
    for page, _, html in rows:
        groups[(html or "").encode()].append(page)
    for page, _, html in rows:
        payload = (html or "").encode()
        ids = [p for p in groups[payload] if p is not None]
        first = min(ids) if ids else None
        revisit = len(payload) >= least and len(groups[payload]) > 1 and first is not None and page != first
        expected.append(
            (page, len(payload), warc.base32_sha1(payload), "revisit" if revisit else "response", first if revisit else None)
        )
    expected.sort(key=str)
    assert sorted(map(tuple, warc.scan(parts, folder).collect()), key=str) == expected
    assert sorted(map(tuple, warc.lookup(parts, pages.select("url"), folder).collect()), key=str) == expected


def test_lookup_of_one_url(spark):
    _, pages = pages_of(spark)
    folder = warc.archive_folder(spark)
    parts = warc.build_index(warc.write_archives(pages, folder), folder)
    wanted = spark.createDataFrame([("https://HOT.net:443/",), ("http://nowhere/",)], "url string")
    assert warc.lookup(parts, wanted, folder).count() == 120


def test_lookup_is_dealt_by_block(spark, monkeypatch):
    """A URL with a third of all captures is read by several tasks, and no key carries a directory there."""
    monkeypatch.setattr(warc, "BLOCK_LINES", 50)
    rows = [(n, "http://hot.test/" if n % 3 == 0 else f"http://h{n % 40}.test/{n}", f"page {n}") for n in range(6_000)]
    rows.append((6_000, None, "none"))
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    folder = warc.archive_folder(spark)
    parts = warc.build_index(warc.write_archives(pages, folder), folder)
    assert parts.count() > 1
    urls = pages.select("url", F.lit("x").alias("blocks"), F.lit(1).alias("file"))
    found = warc.lookup(parts, urls, folder).select("page_id", F.spark_partition_id().alias("task"))
    held = found.toPandas()
    assert sorted(held.page_id) == list(range(6_001))
    assert held[held.page_id % 3 == 0].task.nunique() > 1
    assert warc.lookup(parts, urls.where("false"), folder).count() == 0


def test_empty_archive(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    folder = warc.archive_folder(spark)
    parts = warc.build_index(warc.write_archives(pages, folder), folder)
    assert warc.lookup(parts, pages.select("url"), folder).count() == 0


def test_record_is_readable():
    data = gzip.decompress(gzip.compress(warc.warc_record(1, "u\r\nv", b"a\r\n\r\nb", "D", None, False)))
    fields, payload = warc.parsed_record(data)
    assert payload == b"a\r\n\r\nb" and fields["WARC-Target-URI"] == "u%0D%0Av"


@pytest.mark.parametrize(
    "url, key",
    [
        ("http://www.Example.com/a?z=1&b=2", "com,example)/a?b=2&z=1"),
        ("https://x.y:8443", "y,x:8443)/"),
        (None, "!"),
        ("http://[bad", "!http://[bad"),
    ],
)
def test_reversed_host_key(url, key):
    assert warc.reversed_host_key(url) == key


# --- mixtures ----------------------------------------------------------------


def brute_targets(sizes, weights=(5, 2, 1)):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {name: weights[n % 3] for n, name in enumerate(names)}
    target, open_, budget = {}, set(names), 1.5 * sum(sizes.values())
    while open_:
        level = budget / sum(weight[n] for n in open_)
        full = {n for n in open_ if weight[n] * level >= 2 * sizes[n]}
        if not full:
            target |= {n: weight[n] * level for n in open_}
            break
        target |= {n: 2.0 * sizes[n] for n in full}
        budget -= sum(2 * sizes[n] for n in full)
        open_ -= full
    return target


def test_mix_meets_targets(spark):
    rng = random.Random(4)
    texts = [t for _, t in awkward_texts(3, 200)]
    sources = ["a", "a", "a", "a", "é", "z", "b", "", None]
    rows = [(n, t, sources[rng.randrange(9)]) for n, t in enumerate(texts)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 as size", "2 as hash", "3 as _s")
    found = mixing.mix(frame).collect()
    sizes = defaultdict(int)
    for _, text, source in rows:
        sizes[source] += len((text or "").split())
    target = brute_targets(sizes)
    taken = defaultdict(int)
    by_id = {doc: source for doc, _, source in rows}
    assert len(found) == len(rows)
    for r in found:
        source = by_id[r.doc_id]
        assert r.source_size == sizes[source] and r.target == pytest.approx(target[source])
        assert 0 <= r.taken <= 2 * r["size"]
        taken[source] += r.taken
    for source, words in taken.items():
        assert int(target[source] + 1e-9) - 1 <= words <= target[source] + 1e-6
    again = mixing.mix(frame.repartition(5)).collect()
    assert sorted(map(str, again)) == sorted(map(str, found))


def test_mix_of_repeated_rows_and_nothing(spark):
    rows = [(1, "a b c", "s")] * 10 + [(2, None, "t"), (None, "x y", None), (None, "x y", None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for r in mixing.mix(frame).collect():
        assert r.taken <= 2 * r["size"]
    assert mixing.mix(frame.limit(0)).count() == 0


# --- test items --------------------------------------------------------------


def edit_distance_in(pattern, text):
    row = [0] * (len(text) + 1)
    for n, letter in enumerate(pattern, 1):
        new = [n]
        for m, other in enumerate(text, 1):
            new.append(min(row[m] + 1, new[m - 1] + 1, row[m - 1] + (letter != other)))
        row = new
    return min(row)


@settings(max_examples=300, deadline=None)
@given(st.text("abc ", min_size=1, max_size=70), st.text("abc ", max_size=90))
def test_best_match_is_the_edit_distance(pattern, text):
    masks = {}
    for at, letter in enumerate(pattern):
        masks[letter] = masks.get(letter, 0) | 1 << at
    assert decontaminate.best_match(pattern, text, masks)[0] == edit_distance_in(pattern, text)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("abc", min_size=1, max_size=25), min_size=1, max_size=4), st.text("abc", max_size=60))
def test_finder_equals_brute_force(items, text):
    percent = 20
    finder = decontaminate.Finder(list(enumerate(items)), percent)
    found = {item: distance for item, distance, _ in finder.matches(text)}
    want = {n: edit_distance_in(item, text) for n, item in enumerate(items)}
    assert found == {n: d for n, d in want.items() if d <= decontaminate.budget(items[n], percent)}


def test_contaminated_and_clean(spark, monkeypatch):
    item = "The quick brown fox jumps over the lazy dog near the river bank today"
    edited = item.replace("quick", "quikc").upper()
    rows = [(1, f"before {item} after"), (2, f"x {edited}\n y"), (3, "nothing here " * 900), (4, None), (None, item), (5, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'k' as item_id", "1 as distance")
    tests = spark.createDataFrame([(7, item), (7, item), (8, None), (9, " "), (None, "q" * 40)], "item_id long, text string")
    found = decontaminate.contaminated(docs, tests).collect()
    assert sorted((str(r.doc_id), r.item_id, r.distance) for r in found) == [("1", 7, 0), ("2", 7, 2), ("None", 7, 0)]
    kept = decontaminate.clean(docs, tests)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [3, 4, 5]
    # Items in several automata give the same.
    monkeypatch.setattr(decontaminate, "ITEM_BYTES", 1)
    assert sorted(map(str, decontaminate.contaminated(docs, tests).collect())) == sorted(map(str, found))
    assert decontaminate.contaminated(docs, tests.limit(0)).count() == 0
    assert decontaminate.clean(docs.limit(0), tests).count() == 0


# --- transcripts -------------------------------------------------------------


def lines_of(spark, seed=5, talks=30):
    rng = random.Random(seed)
    rows, gold = [], []
    for conv in range(talks):
        for turn in range(rng.randrange(1, 8)):
            role = ("user", "assistant")[turn % 2]
            for n in range(1 if role == "user" else rng.randrange(1, 4)):
                text = "Could you help me?" if role == "user" else "Certainly the answer is long " * 8
                mark = {"user": "User: ", "assistant": "Assistant: "}[role] if n == 0 and rng.random() < 0.7 else ""
                rows.append((conv if conv != 7 else None, turn, n, mark + text, role, n == 0))
    return spark.createDataFrame(rows, "conv_id long, turn long, line_no long, line string, role string, first boolean")


def model_of(lines):
    from lexloom.llm.chat_queries import labelled

    return transcripts.fit(labelled(lines))


def test_decoding_does_not_depend_on_partitions(spark):
    lines = lines_of(spark)
    model = model_of(lines)
    known = lines.select("conv_id", "turn", "line_no", "line")
    results = []
    for tasks in ("1", "8", "40"):
        spark.conf.set("spark.sql.shuffle.partitions", tasks)
        results.append(sorted(map(tuple, transcripts.parse(known, model).collect()), key=str))
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert results[0] == results[1] == results[2]
    # Against the plain decoder on whole conversations.
    by_talk = defaultdict(list)
    seen = known.select("*", transcripts.observation(known["line"]).alias("seen")).orderBy("conv_id", "turn", "line_no").collect()
    for r in seen:
        by_talk[r.conv_id].append(r)
    want = {}
    for rows in by_talk.values():
        states = transcripts.decoded(model, transcripts._shown(model, [r.seen for r in rows]), None, None)
        want |= {(r.conv_id, r.turn, r.line_no): transcripts.STATES[s] for r, s in zip(rows, states, strict=True)}
    assert {(c, t, n): (role, begins) for c, t, n, role, begins, _ in results[0]} == want


def test_decoding_equals_all_state_paths(spark):
    """Every path of states of short conversations is scored by the model's own counts."""
    model = model_of(lines_of(spark))
    kinds = [*model["kinds"], "never met"]
    rng = random.Random(12)
    size = range(len(transcripts.STATES))
    for length in (1, 2, 3, 4, 5):
        for _ in range(4):
            seen = [rng.choice(kinds) for _ in range(length)]
            shown = [[model["show"][s, model["kinds"].get(kind, len(kinds) - 1)] for s in size] for kind in seen]

            def worth(path, shown=shown):
                moves = sum(model["move"][a, b] for a, b in zip(path, path[1:], strict=False))
                return model["start"][path[0]] + moves + sum(line[s] for line, s in zip(shown, path, strict=True))

            best = max(worth(path) for path in itertools.product(size, repeat=length))
            found = transcripts.decoded(model, transcripts._shown(model, seen), None, None)
            assert worth(found) == pytest.approx(best) and best > -np.inf
            # A text cut in two parts with their edge scores gives a path as good.
            for cut in range(1, length):
                head, tail = (transcripts._shown(model, part) for part in (seen[:cut], seen[cut:]))
                after = transcripts.passage(model, tail, False).max(axis=1)
                entry = transcripts.passage(model, head, True).max(axis=0)
                halves = transcripts.decoded(model, head, None, after) + transcripts.decoded(model, tail, entry, None)
                assert worth(halves) == pytest.approx(best)


def test_roles_are_recovered(spark):
    lines = lines_of(spark, seed=6)
    found = transcripts.parse(lines.drop("role", "first"), model_of(lines))
    both = found.alias("f").join(lines.alias("g"), ["conv_id", "turn", "line_no"]).selectExpr("f.role = g.role as same").collect()
    assert sum(r.same for r in both) / len(both) > 0.95
    first = found.where("conv_id = 0 AND turn = 0 AND line_no = 0").first()
    assert first.rendered == "<|user|>\nCould you help me?"


def test_awkward_lines(spark):
    rows = [(1, None, None, None), (1, 0, 0, ""), (1, 0, 0, ""), (None, 0, 0, "User: hi"), (2, 0, 0, "x" * 100_000)]
    lines = spark.createDataFrame(rows, "conv_id long, turn long, line_no long, line string")
    model = model_of(lines_of(spark))
    assert transcripts.parse(lines, model).count() == 5
    assert transcripts.parse(lines.limit(0), model).count() == 0
