"""Jaccard join of word shingles by prefix filters under several global orders.

A set is the distinct 5-word shingles of a text, as 64-bit hashes; equal sets
are one set with several documents. If two sets have a Jaccard similarity of
`percent` or more, they share a token in their prefixes under any global order
of the tokens. Every order here goes from rare to common, so that tokens of a
single set come first: a set with more of them than its prefix is long has no
partner. Sets are sifted by this twice, by the tokens that any other set holds
and by those that another remaining set holds. The orders of the remaining
tokens differ in how they break ties and in how finely they look at the count.
Candidates must share a prefix token under each order, and are then verified.

Only which sets are connected is asked for, so pairs of sets that are known to
be connected are not looked at again: sets are first compared to a few others
with the same least hash (stars, each verified), and the exact stage looks at
token groups that still hold sets of different components.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm import grams
from lexloom.llm.components import components
from lexloom.session import durable

SHINGLE = 5
PERCENT = 75
ORDERS = 3
STARS = 6
# Latest sets that a star compares with; the exact stage finds what this misses.
LEADERS = 16
# A star of very many sets is looked at in so many parts.
STAR_PARTS = 4

# Longs in the sketch of a set's tokens, one bit for each of that many hash values.
SKETCH = 16
# Token rows: met in one set of a block, the witness of several sets, and these sets.
ALONE, WITNESS, KNOWN = range(3)
_SALTS = [np.uint64(n * 0x9E3779B97F4A7C15 % 2**64) for n in range(1, 33)]


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int):
    """Distinct shingle hashes of each text in order, and where each text's begin."""
    count = len(offsets) - 1
    _, _, hashes, owner = grams.words_of(grams.lowered(data), offsets)
    words = np.bincount(owner, minlength=count)
    begins = np.cumsum(words) - words
    whole = grams.word_grams(hashes, size)
    inside = owner[: len(whole)] == owner[size - 1 :] if len(whole) else np.zeros(0, bool)
    keys, owners = [whole[inside]], [owner[: len(whole)][inside]]
    for short in range(1, size):
        # A text of fewer words is one shingle.
        texts = np.flatnonzero(words == short)
        if len(texts):
            keys.append(grams.word_grams(hashes, short)[begins[texts]] + np.uint64(short))
            owners.append(texts)
    key, text = np.concatenate(keys), np.concatenate(owners)
    order = np.lexsort((key, text))
    key, text = key[order], text[order]
    fresh = np.ones(len(key), bool)
    fresh[1:] = (key[1:] != key[:-1]) | (text[1:] != text[:-1])
    key, text = key[fresh], text[fresh]
    sizes = np.bincount(text, minlength=count)
    return key, text, sizes, np.cumsum(sizes) - sizes


def _set_names(key: np.ndarray, sizes: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """64-bit name of each set, from two sums over its mixed tokens."""
    one = np.concatenate([[np.uint64(0)], np.cumsum(grams.mixed(key))])
    two = np.concatenate([[np.uint64(0)], np.cumsum(grams.mixed(key ^ _SALTS[20]))])
    ends = begins + sizes
    name = grams.mixed((one[ends] - one[begins]) ^ grams.mixed((two[ends] - two[begins]) + sizes.astype(np.uint64)))
    return name.view(np.int64)


_SENT = "bucket int, name long, n int, docs binary, names binary, owners binary, keys binary, held int"


def _set_rows(size: int, buckets: int):
    """A row per document (docs: its id), and token rows per bucket of a block."""
    schema = pa.schema(
        [("bucket", pa.int32()), ("name", pa.int64()), ("n", pa.int32())]
        + [(c, pa.binary()) for c in ("docs", "names", "owners", "keys")]
        + [("held", pa.int32())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in grams.text_blocks(batch, "text"):
                key, text, sizes, begins = shingle_sets(*grams.buffer_of(block.column("text")), size)
                names = _set_names(key, sizes, begins)
                names[sizes == 0] = 0
                docs = block.column("doc_id").cast(pa.int64())
                rows = [
                    (n % buckets, name, count, b"null" if doc is None else doc.to_bytes(8, "little", signed=True), None, None, None, None)
                    for n, (name, count, doc) in enumerate(zip(names.tolist(), sizes.tolist(), docs.to_pylist(), strict=True))
                ]
                # One text per distinct set; copies send no tokens.
                _, first = np.unique(names, return_index=True)
                chosen = np.zeros(len(sizes), bool)
                chosen[first] = True
                mine = chosen[text]
                token, owner = key[mine], text[mine]
                _, first, where, met = np.unique(token, return_index=True, return_inverse=True, return_counts=True)
                common = met > 1
                rows += _packed(token, owner, names, np.flatnonzero(~common[where]), buckets, ALONE)
                # A token of several sets of this block: one witness, and its sets know already.
                rows += _packed(token, owner, names, first[common], buckets, WITNESS)
                # One row for the latter, dealt by the first token of the block.
                for _, *rest in _packed(token, owner, names, np.flatnonzero(common[where]), 1, KNOWN):
                    rows.append((int(token[0] % np.uint64(buckets)), *rest))
                columns = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(column, field.type) for column, field in zip(columns, schema, strict=True)], schema=schema
                )

    return run


def _packed(token, owner, names, rows, buckets, held):
    """Token rows, one for each bucket; in it, a bit tells where the next set begins."""
    rows = np.sort(rows)
    bucket = (token[rows] % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    rows, bucket = rows[order], bucket[order]
    numbers, first = np.unique(bucket, return_index=True)
    for number, part in zip(numbers.tolist(), np.split(rows, first[1:]), strict=False):
        if len(part):
            texts, owners = np.unique(owner[part], return_inverse=True)
            yield (
                number,
                None,
                None,
                None,
                names[texts].tobytes(),
                np.packbits(np.diff(owners, prepend=0).astype(bool)).tobytes(),
                token[part].tobytes(),
                held,
            )


def _unpacked(row: dict) -> tuple[np.ndarray, np.ndarray]:
    """Set name and token of each packed entry."""
    keys = np.frombuffer(row["keys"], np.uint64)
    steps = np.unpackbits(np.frombuffer(row["owners"], np.uint8), count=len(keys))
    return np.frombuffer(row["names"], np.int64)[np.cumsum(steps, dtype=np.int64)], keys


_COUNTED = "name long, n int, doc_id long, tokens binary"
# Tokens known by blocks that a task folds at once: copies in many blocks send the same ones.
KNOWN_AT_ONCE = 2_000_000


def _distinct(names: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which entries to keep for each name and token once."""
    order = np.lexsort((keys, names))
    fresh = np.ones(len(order), bool)
    fresh[1:] = (names[order[1:]] != names[order[:-1]]) | (keys[order[1:]] != keys[order[:-1]])
    return order[fresh]


def _counted_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Document rows as they are; per set the tokens that other sets hold too, none twice in a row."""
    held, known, size = [], [], 0

    def tokens_of(names, keys):
        order = _distinct(names, keys)
        names = names[order]
        opens = np.ones(len(names), bool)
        opens[1:] = names[1:] != names[:-1]
        first = np.flatnonzero(opens)
        counts = np.diff(np.append(first, len(names)))
        empty = pa.nulls(len(first), pa.int32()), pa.nulls(len(first), pa.int64())
        yield pa.RecordBatch.from_arrays(
            [pa.array(names[first]), *empty, grams.binary_rows(keys[order], counts)], names=["name", "n", "doc_id", "tokens"]
        )

    def settled():
        if not held:
            return
        names, keys, witness = (np.concatenate(c) for c in zip(*held, strict=True))
        held.clear()
        order = np.lexsort((names, keys))
        names, keys, witness = names[order], keys[order], witness[order]
        opens = np.ones(len(keys), bool)
        opens[1:] = keys[1:] != keys[:-1]
        # Held by several sets: by two names, or seen to be by a block.
        several = witness.copy()
        several[1:] |= ~opens[1:] & (names[1:] != names[:-1])
        group = np.cumsum(opens) - 1
        kept = (np.bincount(group, weights=several) > 0)[group] & ~witness
        if kept.any():
            yield from tokens_of(names[kept], keys[kept])

    for batch in batches:
        docs = []
        for row in batch.to_pylist():
            if row["docs"] is not None:
                doc = None if row["docs"] == b"null" else int.from_bytes(row["docs"], "little", signed=True)
                docs.append((row["name"], row["n"], doc))
                continue
            names, keys = _unpacked(row)
            if row["held"] == KNOWN:
                known.append((names, keys))
                size += len(keys)
                if size > KNOWN_AT_ONCE:
                    names, keys = (np.concatenate(c) for c in zip(*known, strict=True))
                    once = _distinct(names, keys)
                    known, size = [(names[once], keys[once])], len(once)
                    # Few repeats: nothing is gained by holding on to them.
                    if size > KNOWN_AT_ONCE // 2:
                        yield from tokens_of(*known[0])
                        known, size = [], 0
            else:
                held.append((names, keys, np.full(len(keys), row["held"] == WITNESS)))
        if docs:
            columns = list(zip(*docs, strict=True))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(columns[0], pa.int64()),
                    pa.array(columns[1], pa.int32()),
                    pa.array(columns[2], pa.int64()),
                    pa.nulls(len(docs), pa.binary()),
                ],
                names=["name", "n", "doc_id", "tokens"],
            )
    if known:
        yield from tokens_of(*(np.concatenate(c) for c in zip(*known, strict=True)))
    yield from settled()


def order_keys(tokens: np.ndarray, sets: np.ndarray, nth: int) -> np.ndarray:
    """Rank of each token, held by so many sets, under the `nth` global order, as one number."""
    fineness = (16, 2, 1)[nth % 3]
    rarity = np.floor(np.log2(sets) * fineness).astype(np.uint64)
    return (rarity << np.uint64(48)) | (grams.mixed(tokens ^ _SALTS[nth]) >> np.uint64(16))


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def _reach(n: int, held: int, percent: int) -> int:
    """Tokens of other sets in the prefix of a set of `n` tokens, `held` of which others hold; 0: no partner."""
    if 100 * held < percent * n:
        return 0
    return max(prefix_length(n, percent) - (n - held), 0)


def _sifted_rows(percent: int):
    """Sets whose prefix holds a token of another set, with the tokens that other sets hold.

    Rows of a set follow each other: its size, then its tokens in any number of
    rows, which are folded as they come, so that one set is held at a time and
    each of its tokens about twice at most.
    """

    def folded(parts: list[np.ndarray]) -> np.ndarray:
        return np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.int64)

    def emitted(names: list[int], sizes: list[int], shared: list[np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [
                pa.array(names, pa.int64()),
                pa.array(sizes, pa.int32()),
                pa.ListArray.from_arrays(
                    np.cumsum([0] + [len(k) for k in shared], dtype=np.int32),
                    np.concatenate(shared) if shared else np.zeros(0, np.int64),
                ),
            ],
            names=["name", "n", "shared"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, size, parts, held, bound = None, 0, [], 0, 0
        for batch in batches:
            names, sizes, shared = [], [], []
            columns = (batch.column("name").to_pylist(), batch.column("n").to_pylist(), batch.column("tokens"))
            for name, n, blob in zip(*columns, strict=True):
                if name != current:
                    keys = folded(parts)
                    if current is not None and _reach(size, len(keys), percent):
                        names.append(current)
                        sizes.append(size)
                        shared.append(keys)
                    current, size, parts, held, bound = name, 0, [], 0, 0
                if n is not None:
                    size = n
                    continue
                parts.append(np.frombuffer(blob.as_buffer(), np.int64))
                held += len(parts[-1])
                if held > 2 * max(bound, size):
                    parts = [folded(parts)]
                    held = bound = len(parts[0])
            # Parts of a set that goes on must not keep the batch.
            parts = [folded(parts)] if parts else []
            held = bound = len(parts[0]) if parts else 0
            yield emitted(names, sizes, shared)
        keys = folded(parts)
        if current is not None and _reach(size, len(keys), percent):
            yield emitted([current], [size], [keys])

    return run


def _survivor_rows(percent: int):
    """Of the sets still left, sorted tokens that others hold, prefixes and star keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            columns = (batch.column(c) for c in ("name", "n", "tokens", "counts"))
            for name, n, tokens, counts in zip(*columns, strict=True):
                n = n.as_py()
                keys = tokens.values.to_numpy().view(np.uint64)
                sets = counts.values.to_numpy()
                order = np.argsort(keys)
                keys, sets = keys[order], sets[order]
                length = _reach(n, len(keys), percent)
                if not length:
                    continue
                prefixes = [
                    keys[np.argsort(order_keys(keys, sets, nth), kind="stable")[:length]].view(np.int64).tolist()
                    for nth in range(ORDERS)
                ]
                stars = [int(grams.mixed(keys ^ _SALTS[10 + nth]).min()) for nth in range(STARS)]
                bits = np.zeros(64 * SKETCH, bool)
                bits[keys % np.uint64(64 * SKETCH)] = True
                out.append(
                    (
                        name.as_py(),
                        n,
                        keys.tobytes(),
                        prefixes,
                        np.array(stars, np.uint64).view(np.int64).tolist(),
                        np.packbits(bits).view(np.int64).tolist(),
                    )
                )
            if out:
                columns = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(columns[0], pa.int64()),
                        pa.array(columns[1], pa.int32()),
                        pa.array(columns[2], pa.binary()),
                        pa.array(columns[3], pa.list_(pa.list_(pa.int64()))),
                        pa.array(columns[4], pa.list_(pa.int64())),
                        pa.array(columns[5], pa.list_(pa.int64())),
                    ],
                    names=["name", "n", "shared", "prefixes", "stars", "sketch"],
                )

    return run


def linked(shared_a: np.ndarray, n_a: int, shared_b: np.ndarray, n_b: int, percent: int) -> bool:
    """Exact test of two sets by their sizes and their tokens held by other sets too."""
    if 100 * min(n_a, n_b) < percent * max(n_a, n_b):
        return False
    at = np.minimum(shared_b.searchsorted(shared_a), len(shared_b) - 1)
    both = int((shared_b[at] == shared_a).sum())
    return 100 * both >= percent * (n_a + n_b - both)


def _star_rows(percent: int):
    """Compare each set with the latest unlinked sets of its star; rows of a star follow each other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, leaders = None, deque(maxlen=LEADERS)
        for batch in batches:
            edges = []
            columns = (batch.column(c).to_pylist() for c in ("nth", "star", "part", "name", "n", "shared"))
            for nth, star, part, name, n, blob in zip(*columns, strict=True):
                shared = np.frombuffer(blob, np.uint64)
                if (nth, star, part) != current:
                    current, leaders = (nth, star, part), deque(maxlen=LEADERS)
                for other, count, tokens in leaders:
                    if linked(shared, n, tokens, count, percent):
                        edges.append((other, name))
                        break
                else:
                    leaders.append((name, n, shared))
            if edges:
                a, b = zip(*edges, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def _verified_rows(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("a", "b", "n_a", "n_b", "shared_a", "shared_b"))
            edges = [
                (a, b)
                for a, b, n_a, n_b, s_a, s_b in zip(*columns, strict=True)
                if linked(np.frombuffer(s_a, np.uint64), n_a, np.frombuffer(s_b, np.uint64), n_b, percent)
            ]
            if edges:
                a, b = zip(*edges, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def _candidates(survivors: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Pairs of sets in different components that share a prefix token under every order.

    Both sets of a link hold `percent / (100 + percent)` of their sizes' sum in
    shared tokens, so the smaller one must hold that share of twice its own
    size. A bit that only one of two sketches has is a token that the other set
    lacks, which bounds what they share. This, the sizes and the first order
    make the pairs; the other orders are looked up in the prefixes of each pair.
    """
    bits = [f"s{at}" for at in range(SKETCH)]
    sets = survivors.select("name", "n", F.expr("octet_length(shared) div 8").alias("held"), "prefixes", "sketch").join(
        labels.withColumnRenamed("node", "name"), "name", "left"
    )
    sets = durable(sets.withColumn("root", F.coalesce("root", "name")), "labelled")
    tokens = sets.select(
        "name",
        "n",
        "held",
        "root",
        *[F.element_at("sketch", at + 1).alias(bit) for at, bit in enumerate(bits)],
        F.explode(F.element_at("prefixes", 1)).alias("token"),
    )
    mixed = tokens.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high")
    tokens = durable(tokens.join(mixed.select("token"), "token", "left_semi"), "tokens")
    enough = f"{100 + percent} * least(a.held, b.held) >= {percent} * (a.n + b.n)"
    only_a = " + ".join(f"bit_count(a.{bit} & ~b.{bit})" for bit in bits)
    only_b = " + ".join(f"bit_count(b.{bit} & ~a.{bit})" for bit in bits)
    close = f"{100 + percent} * least(a.held - ({only_a}), b.held - ({only_b})) >= {percent} * (a.n + b.n)"
    a = tokens.where(f"{100 + percent} * held >= {2 * percent} * n").alias("a")
    b = tokens.alias("b")
    pairs = (
        a.join(b, F.col("a.token") == F.col("b.token"))
        .where("a.n < b.n OR (a.n = b.n AND a.name < b.name)")
        .where(f"a.root <> b.root AND 100 * a.n >= {percent} * b.n AND {enough} AND {close}")
        .select(F.col("a.name").alias("a"), F.col("b.name").alias("b"))
        .distinct()
    )
    prefixes = sets.select("name", "prefixes")
    both = pairs.join(prefixes.toDF("a", "p"), "a").join(prefixes.toDF("b", "q"), "b")
    for nth in range(1, ORDERS):
        both = both.where(F.arrays_overlap(F.element_at("p", nth + 1), F.element_at("q", nth + 1)))
    return both.select("a", "b")


def document_sets(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """Rows of documents (`doc_id`, `n`, `name` of the set) and of tokens (`name`, `tokens`)."""
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (
        docs.select(F.col("doc_id").cast("long"), "text")
        .mapInArrow(_set_rows(shingle, tasks), _SENT)
        .repartitionById(tasks, "bucket")
        .mapInArrow(_counted_rows, _COUNTED)
    )


def near_duplicates(docs: DataFrame, percent: int = PERCENT, shingle: int = SHINGLE) -> DataFrame:
    """Components of documents linked by a shingle Jaccard of `percent` or more.

    Takes `doc_id` and `text`, returns `doc_id`, `n_shingles` and
    `component_id`, the smallest doc_id reachable by links. Letters A-Z are
    lower-cased. A text of fewer words than a shingle is one shingle; a null or
    wordless text has none and is linked with nothing, so its component is
    itself. A null doc_id takes part and stays null; a component of null ids
    only has a null id. Repeated rows are equal sets and so linked. Shingles
    are compared by 64-bit hashes. Other columns are not used.
    """
    spark = docs.sparkSession
    counted = durable(document_sets(docs, shingle), "sets")
    rows = counted.where("tokens IS NULL").select("doc_id", "n", "name")
    sets = rows.where("n > 0").groupBy("name").agg(F.min("doc_id").alias("first_doc"), F.max("n").alias("n"))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    none = F.lit(None)
    sifted = (
        counted.where("tokens IS NOT NULL")
        .select("name", none.cast("int").alias("n"), "tokens")
        .unionByName(sets.select("name", "n", none.cast("binary").alias("tokens")))
        .repartition(tasks, "name")
        # The size of a set first, then its tokens.
        .sortWithinPartitions("name", F.col("n").desc_nulls_last())
        .mapInArrow(_sifted_rows(percent), "name long, n int, shared array<long>")
    )
    sifted = durable(sifted, "sifted")
    tokens = sifted.select("name", "n", F.explode("shared").alias("token"))
    counts = tokens.groupBy("token").agg(F.count("*").alias("sets")).where("sets > 1")
    survivors = (
        tokens.join(durable(counts, "counts"), "token")
        .groupBy("name", "n")
        .agg(F.collect_list("token").alias("tokens"), F.collect_list("sets").alias("counts"))
        .mapInArrow(
            _survivor_rows(percent),
            "name long, n int, shared binary, prefixes array<array<long>>, stars array<long>, sketch array<long>",
        )
    )
    survivors = durable(survivors, "survivors")
    stars = (
        survivors.select("name", "n", "shared", "stars", F.posexplode("stars").alias("nth", "star"))
        .withColumn("part", F.pmod(F.xxhash64("name", "nth"), F.lit(STAR_PARTS)))
        .repartition("nth", "star", "part")
        # Sets alike in size, or in another least hash, follow each other.
        .withColumn("turn", F.when(F.col("nth") % 2 == 0, F.col("n").cast("long")).otherwise(F.get("stars", (F.col("nth") + 1) % STARS)))
        .drop("stars")
        .sortWithinPartitions("nth", "star", "part", "turn", "n", "name")
        .mapInArrow(_star_rows(percent), "a long, b long")
    )
    labels = durable(components(stars), "stars")
    shared = survivors.select("name", "n", "shared")
    exact = (
        _candidates(survivors, labels, percent)
        .join(shared.toDF("a", "n_a", "shared_a"), "a")
        .join(shared.toDF("b", "n_b", "shared_b"), "b")
        .mapInArrow(_verified_rows(percent), "a long, b long")
    )
    edges = labels.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(exact)
    roots = durable(components(edges), "roots")
    placed = sets.join(roots.withColumnRenamed("node", "name"), "name", "left").select(
        "name", "first_doc", F.coalesce("root", "name").alias("root")
    )
    placed = durable(placed, "placed")
    least = durable(placed.groupBy("root").agg(F.min("first_doc").alias("component_id")), "least")
    named = placed.join(least, "root").select("name", "component_id")
    return rows.join(named, "name", "left").select(
        "doc_id",
        F.col("n").cast("long").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
    )
