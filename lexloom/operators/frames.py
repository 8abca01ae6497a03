"""Context windows, co-occurrence counts and next-token scoring.

Windows are array slices inside the row of a file, so they need no shuffle.
Pairs are counted once without regard to direction and mirrored after the
aggregation, which halves both the pairs folded and the groups kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.functions.lexis import bind
from lexloom.operators.profile import token_rows
from lexloom.operators.store import dense_index
from lexloom.session import BROADCAST_BYTES, broadcast_if_small, durable, stored_bytes

# Tokens that may repeat within the recent tokens of a
# continuation, how many tokens are recent, candidates per step, and steps.
REPEATABLE = ["import", ","]
RECENT = 5
CANDIDATES = 10
STEPS = 20

# Tokens whose pairs are folded at once; centers in a block of falling gains.
CHUNK_TOKENS = 500_000
BLOCK_CENTERS = 256
# Parts of all pairs by hash, each summed at once.
PAIR_SLICES = 1024
# Odd number whose products spread pairs over the slices.
_SPREAD = np.int64(-7046029254386353131)
# Pairs sent to every task to pick their gains, as a table on disk.
SOUGHT_BYTES = 8 * 1024 * 1024


def _rows_with_tokens(tokenised: DataFrame) -> DataFrame:
    """A row for each token with its file's list beside it.

    The list is no copy: slices of it are taken in the same stage as the rows are made.
    """
    rows = tokenised.select("doc_id", "language", "tokens", F.posexplode_outer("tokens").alias("pos", "token"))
    return rows.where(F.col("token").isNotNull())


def _before(many: int) -> Column:
    pos = F.col("pos")
    return F.slice("tokens", F.greatest(pos - many, F.lit(0)) + 1, F.least(pos, F.lit(many)))


def context_frames(tokenised: DataFrame, window: int = 5) -> DataFrame:
    """Neighbours within +-window of each token, the token itself left out."""
    right = F.slice("tokens", F.col("pos") + 2, F.lit(window))
    return _rows_with_tokens(tokenised).select(
        "doc_id", "language", "pos", "token", F.concat(_before(window), right).alias("context")
    )


def recent_frames(tokenised: DataFrame, recent: int = RECENT) -> DataFrame:
    """The up to `recent` tokens before each token."""
    return _rows_with_tokens(tokenised).select("doc_id", "language", "pos", "token", _before(recent).alias("recent"))


def _regrouped(rows: DataFrame, column: str) -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct("pos", column)))
    return rows.groupBy("doc_id", "language").agg(
        F.transform(ordered, lambda s: s[column]).alias("tokens")
    )


def pruned(tokenised: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Token lists without the tokens that are not in the vocabulary (a stored
    table).

    Files are hashed by id while they are compact, so regrouping the tokens of
    a file stays in its partition.
    """
    rows = token_rows(tokenised.repartition("doc_id"))
    kept = rows.join(broadcast_if_small(vocabulary.select("token")), "token", "left_semi")
    return _regrouped(kept, "token")


def pair_counts(tokenised: DataFrame, window: int = 5) -> DataFrame:
    """(center, context, n): how often two tokens are within `window`."""

    def rights(tokens: Column):
        return F.transform(
            tokens,
            lambda t, i: F.struct(
                t.alias("center"), F.slice(tokens, i + 2, F.lit(window)).alias("rights")
            ),
        )

    ahead = (
        tokenised.select(F.explode_outer(bind(F.col("tokens"), rights)).alias("frame"))
        .select("frame.center", F.explode_outer("frame.rights").alias("context"))
        .where(F.col("context").isNotNull())
    )
    unordered = ahead.groupBy(
        F.least("center", "context").alias("low"), F.greatest("center", "context").alias("high")
    ).agg(F.count("*").alias("n"))
    return _mirrored(unordered)


def _mirrored(unordered: DataFrame) -> DataFrame:
    """(center, context, n) both ways of unordered pairs (low, high, n)."""
    # Two equal tokens are each other's context, which is twice the same pair.
    low, high, n = F.col("low"), F.col("high"), F.col("n")

    def counted(center: Column, context: Column, times: Column) -> Column:
        return F.struct(center.alias("center"), context.alias("context"), times.alias("n"))

    both = F.when(low == high, F.array(counted(low, high, 2 * n))).otherwise(
        F.array(counted(low, high, n), counted(high, low, n))
    )
    return unordered.select(F.inline(both))


def _counted_windows(window: int, near: bool = False):
    """Unordered pairs of numbers within `window` of each other, folded in each batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("tokens")
            lengths = lists.value_lengths().fill_null(0).to_numpy()
            chunk = (np.cumsum(lengths) - lengths) // CHUNK_TOKENS
            cuts = np.flatnonzero(np.diff(chunk, prepend=-1)).tolist() + [len(lists)]
            for low, high in zip(cuts, cuts[1:]):
                numbers = lists.slice(low, high - low).flatten().to_numpy().astype(np.int64)
                yield _folded(numbers, np.repeat(np.arange(high - low), lengths[low:high]), window, near)

    return run


def _folded(numbers: np.ndarray, files: np.ndarray, window: int, near: bool = False) -> pa.RecordBatch:
    keys = [np.zeros(0, np.int64)]
    for step in range(1, window + 1):
        left, right = numbers[:-step], numbers[step:]
        same = files[:-step] == files[step:]
        keys.append((np.minimum(left, right) << 32 | np.maximum(left, right))[same])
    if near:
        # A neighbour counts `window` times, a word `window` away once.
        parts = np.repeat(np.arange(window + 1, 0, -1), [len(some) for some in keys])
        found, times = _sorted_pairs(np.concatenate(keys), parts)
        starts = np.flatnonzero(np.diff(found, prepend=-1))
        found, times = found[starts], np.add.reduceat(times, starts) if len(starts) else times
    else:
        found, times = np.unique(np.concatenate(keys), return_counts=True)
    return pa.RecordBatch.from_pydict(
        {"low": (found >> 32).astype(np.int32), "high": (found & 0xFFFFFFFF).astype(np.int32), "n": times.astype(np.int64)}
    )


def _sorted_pairs(pair: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of numbers in order with what belongs to them; sorted as one number where they fit, which is faster."""
    bits, more = int(pair.max(initial=0) >> 32).bit_length(), int(times.max(initial=0)).bit_length()
    bits = max(bits, int((pair & 0xFFFFFFFF).max(initial=0)).bit_length())
    if 2 * bits + more > 63:
        order = np.argsort(pair, kind="stable")
        return pair[order], times[order]
    packed = np.sort((pair >> 32 << bits | pair & 0xFFFFFFFF) << more | times)
    pair = packed >> more
    return pair >> bits << 32 | pair & ((1 << bits) - 1), packed & ((1 << more) - 1)


def _sliced(window: int, near: bool = False):
    """Counts of a chunk as a row for each slice, so that few rows are shuffled: (slice, pair, n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for counts in _counted_windows(window, near)(batches):
            pair = counts.column("low").to_numpy().astype(np.int64) << 32 | counts.column("high").to_numpy()
            place = (pair * _SPREAD).view(np.uint64) >> np.uint64(40)
            place = (place % np.uint64(PAIR_SLICES)).astype(np.int32)
            # Numbers of two bytes are sorted by their digits, which is faster.
            order = np.argsort(place.astype(np.uint16), kind="stable")
            starts = np.flatnonzero(np.diff(place[order], prepend=-1))
            ends = pa.array(np.append(starts, len(order)).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(place[order][starts]),
                    pa.ListArray.from_arrays(ends, pa.array(pair[order])),
                    pa.ListArray.from_arrays(ends, pa.array(counts.column("n").to_numpy()[order])),
                ],
                names=["slice", "pair", "n"],
            )

    return run


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(pair, n) of each slice, sorted, from the rows of `_sliced`, which come slice by slice."""
    place, held = None, []
    for batch in batches:
        places = batch.column("slice").to_numpy()
        cuts = np.flatnonzero(places[1:] != places[:-1]) + 1
        for low, high in zip([0, *cuts], [*cuts, len(places)]):
            if low == high:
                continue
            if held and places[low] != place:
                yield _summed(held)
                held = []
            place = places[low]
            held.append([batch.column(name).slice(low, high - low).flatten().to_numpy().copy() for name in ("pair", "n")])
    if held:
        yield _summed(held)


def _summed(parts: list[list[np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    pair, times = (np.concatenate(column) for column in zip(*parts))
    order = np.argsort(pair, kind="stable")
    pair = pair[order]
    starts = np.flatnonzero(np.append(True, pair[1:] != pair[:-1])[: len(pair)])
    return pair[starts], np.add.reduceat(times[order], starts) if len(starts) else times


def _summed_once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(low, high, n) of the rows of `_sliced`."""
    for pair, n in _slices(batches):
        low, high = (pair >> 32).astype(np.int32), (pair & 0xFFFFFFFF).astype(np.int32)
        yield pa.RecordBatch.from_pydict({"low": low, "high": high, "n": n})


def _summed_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(center, context, n) both ways of the rows of `_sliced`."""
    for pair, n in _slices(batches):
        yield _both_ways(pair, n)


def _both_ways(pair: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    low, high = (pair >> 32).astype(np.int32), (pair & 0xFFFFFFFF).astype(np.int32)
    # Two equal tokens are each other's context, which is twice the same pair.
    other = low != high
    both = np.concatenate([pair, high[other].astype(np.int64) << 32 | low[other]])
    n = np.concatenate([np.where(other, n, 2 * n), n[other]])
    # Runs of one center are stored in little space.
    order = np.argsort(both)
    both = both[order]
    return pa.RecordBatch.from_pydict(
        {
            "center": (both >> 32).astype(np.int32),
            "context": (both & 0xFFFFFFFF).astype(np.int32),
            "n": n[order],
        }
    )


def _looked_up(words: pa.Array):
    """Token lists as lists of the words' positions, other tokens left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("tokens")
            lengths = lists.value_lengths().fill_null(0).to_numpy()
            coded = lists.flatten().dictionary_encode("encode")
            places = pc.index_in(coded.dictionary, value_set=words.value).take(coded.indices)
            kept = places.is_valid().to_numpy(zero_copy_only=False)
            ends = np.append(0, np.cumsum(kept))[np.append(0, np.cumsum(lengths))]
            numbers = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), places.drop_null())
            yield pa.RecordBatch.from_arrays([numbers], names=["tokens"])

    return run


def numbered_lists(tokenised: DataFrame, frequent: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(word, token) of the tokens of `frequent`, and the token lists (tokens) as such numbers, without the others.

    Numbers sort like the tokens they stand for; null is a token like others if `frequent`
    holds it. Tokens become numbers in the batches of the scan while the vocabulary is
    within the size of a broadcast, else by a join.
    """
    numbered = dense_index(frequent.select("token"), [F.col("token")], "word")
    index = durable(numbered.select(F.col("word").cast("int").alias("word"), "token"), "index")
    if stored_bytes(index) <= BROADCAST_BYTES:
        words = index.orderBy("word").select("token").toArrow().column("token").combine_chunks()
        shared = index.sparkSession.sparkContext.broadcast(words)
        return index, tokenised.select("tokens").mapInArrow(_looked_up(shared), "tokens array<int>")
    rows = tokenised.repartition("doc_id").select("doc_id", "language", F.posexplode_outer("tokens").alias("pos", "_token"))
    rows = rows.where("pos IS NOT NULL").join(index, F.col("_token").eqNullSafe(F.col("token")))
    return index, _regrouped(rows, "word").select("tokens")


def _dealt_slices(lists: DataFrame, window: int, near: bool = False) -> DataFrame:
    counts = lists.mapInArrow(_sliced(window, near), "slice int, pair array<long>, n array<long>")
    return counts.repartition("slice").sortWithinPartitions("slice")


def near_pairs(lists: DataFrame, window: int) -> DataFrame:
    """(center, context, n) of lists of numbers: nearer words count more, from `window` down to 1.

    This is `window` times what windows of a random size up to `window` count on average.
    """
    return _mirrored(_dealt_slices(lists, window, near=True).mapInArrow(_summed_once, "low int, high int, n long"))


def numbered_pairs(
    tokenised: DataFrame, frequent: DataFrame, window: int = 5
) -> tuple[DataFrame, DataFrame]:
    """Pair counts over the tokens of `frequent` only, as numbers.

    Returns (word, token) and (center, context, n). Pairs are counted in the batches
    that number the tokens, so that only counts are shuffled. They travel as arrays, one
    for each chunk and slice of the pairs, and a slice is summed at once.
    """
    index, lists = numbered_lists(tokenised, frequent)
    return index, durable(_dealt_slices(lists, window).mapInArrow(_summed_slices, "center int, context int, n long"), "pairs")


def named_pairs(index: DataFrame, pairs: DataFrame) -> DataFrame:
    """Numbered pairs with their tokens, other columns kept."""
    centers = broadcast_if_small(index.select(F.col("word").alias("center"), F.col("token").alias("_center")))
    contexts = broadcast_if_small(index.select(F.col("word").alias("context"), F.col("token").alias("_context")))
    others = [name for name in pairs.columns if name not in ("center", "context")]
    return (
        pairs.join(centers, "center")
        .join(contexts, "context")
        .select(F.col("_center").alias("center"), F.col("_context").alias("context"), *others)
    )


def corpus_pairs(tokenised: DataFrame, frequent: DataFrame, window: int = 5) -> DataFrame:
    """(center, context, n) over the tokens of `frequent` only."""
    return named_pairs(*numbered_pairs(tokenised, frequent, window))


def positive_pmi(pairs: DataFrame) -> DataFrame:
    """Positive pointwise mutual information of counted pairs (a stored table).

    Counts are symmetric, so one set of totals serves both sides.
    """
    totals = durable(pairs.groupBy("center").agg(F.sum("n").alias("total")), "totals")
    whole = totals.select(F.sum("total").cast("double")).scalar()
    score = F.log(F.col("n") * whole / (F.col("_a").cast("double") * F.col("_b")))
    centers = broadcast_if_small(totals.select("center", F.col("total").alias("_a")))
    contexts = broadcast_if_small(totals.select(F.col("center").alias("context"), F.col("total").alias("_b")))
    return (
        pairs.join(centers, "center")
        .join(contexts, "context")
        .select("center", "context", F.greatest(score, F.lit(0.0)).alias("ppmi"))
    )


class Scores(NamedTuple):
    """Smoothed log probabilities of counted pairs.

    log P(center | context) is the context's `floor` for a pair never seen and
    `floor + gain` for a counted one. The gains of a context word are also kept
    as blocks in falling order, so that a search can stop early.
    """

    words: DataFrame  # token, word, floor
    gains: DataFrame  # context, center (numbers), gain
    blocks: DataFrame  # context, block, top (its largest gain), centers


def score_tables(index: DataFrame, pairs: DataFrame, alpha: float = 0.1, block: int = BLOCK_CENTERS) -> Scores:
    totals = durable(pairs.groupBy("context").agg(F.sum("n").alias("total")), "totals")
    words = totals.select(F.count("*").cast("double")).scalar()
    floors = totals.select(
        F.col("context").alias("word"),
        F.log(alpha / (F.col("total") + alpha * words)).alias("floor"),
    )
    gains = durable(pairs.select("context", "center", F.log((F.col("n") + alpha) / alpha).alias("gain")), "gains")
    falling = Window.partitionBy("context").orderBy(F.desc("gain"), "center")
    blocks = (
        gains.withColumn("block", F.floor((F.row_number().over(falling) - 1) / block).cast("int"))
        .groupBy("context", "block")
        .agg(F.max("gain").alias("top"), F.collect_list("center").alias("centers"))
    )
    return Scores(durable(index.join(floors, "word"), "words"), gains, durable(blocks, "blocks"))


def _known_contexts(contexts: DataFrame, scores: Scores) -> DataFrame:
    """(key, words): the known words of each context, sorted, as numbers."""
    known = contexts.select("key", F.explode("context").alias("token")).join(scores.words, "token")
    return known.groupBy("key").agg(F.array_sort(F.collect_list("word")).alias("words"))


def best_centers(asked: DataFrame, scores: Scores, topn: int = CANDIDATES) -> DataFrame:
    """(words, center, score, rank) for each (words), a stored table of distinct sorted lists of numbers.

    Blocks of gains are read in falling order, twice as many in each round. Every
    center met is scored exactly. A list of words is done when its last place
    exceeds what the unread blocks' largest gains add up to, since no center
    that was never met can score more.
    """
    floors = scores.words.select(F.col("word").alias("context"), "floor")
    based = asked.select("words", F.explode("words").alias("context")).join(floors, "context")
    waiting = durable(based.groupBy("words").agg(F.sum("floor").alias("base")), "waiting")
    ranking = Window.partitionBy("words").orderBy(F.desc("score"), "center")
    done, met, low, high = [], None, 0, 1
    while True:
        terms = waiting.select("words", F.explode("words").alias("context"))
        read = scores.blocks.where((F.col("block") >= low) & (F.col("block") < high))
        fresh = (
            terms.distinct().join(read, "context").select("words", F.explode("centers").alias("center")).distinct()
        )
        wanted = durable(fresh.select("words", "center", F.explode("words").alias("context")), "wanted")
        # All gains are read, but only wanted ones are shuffled while the wanted pairs fit a broadcast.
        sought = broadcast_if_small(durable(wanted.select("context", "center").distinct(), "sought"), SOUGHT_BYTES)
        gained = (
            wanted.join(scores.gains.join(sought, ["context", "center"], "left_semi"), ["context", "center"])
            .groupBy("words", "center")
            .agg(F.sum("gain").alias("gain"))
        )
        scored = gained.join(waiting, "words").select(
            "words", "center", F.round(F.col("base") + F.col("gain"), 6).alias("score")
        )
        if met is not None:
            scored = scored.unionByName(met.join(waiting, "words", "left_semi").drop("rank"))
            scored = scored.groupBy("words", "center").agg(F.max("score").alias("score"))
        met = durable(
            scored.withColumn("rank", F.row_number().over(ranking)).where(F.col("rank") <= topn), "met"
        )
        unread = scores.blocks.where(F.col("block") == high).select("context", "top")
        most = (
            terms.join(unread, "context", "left")
            .groupBy("words")
            .agg(F.count("top").alias("_more"), F.sum(F.coalesce("top", F.lit(0.0))).alias("_most"))
        )
        last = met.where(F.col("rank") == topn).select("words", F.col("score").alias("_last"))
        # One unit of rounding more, so that equal scores are compared by their words.
        beaten = F.coalesce(F.col("_last") > F.round(F.col("base") + F.col("_most"), 6) + 1e-6, F.lit(False))
        open_ = waiting.join(most, "words").join(last, "words", "left").where((F.col("_more") > 0) & ~beaten)
        still = durable(open_.select("words", "base"), "waiting")
        done.append(met.join(still, "words", "left_anti"))
        if still.isEmpty():
            return _filled(reduce(DataFrame.unionByName, done), asked, based, scores, topn)
        waiting, low, high = still, high, 3 * high - 2 * low


def _filled(best: DataFrame, asked: DataFrame, based: DataFrame, scores: Scores, topn: int) -> DataFrame:
    """Lists with fewer than `topn` centers filled up with the first other words, which score the base."""
    # The first 2 * topn words hold topn that a list with fewer centers lacks.
    first = [r.word for r in scores.words.select("word").orderBy("word").limit(2 * topn).collect()]
    short = best.groupBy("words").agg(F.collect_list("center").alias("_centers")).where(F.size("_centers") < topn)
    base = based.groupBy("words").agg(F.sum("floor").alias("base"))
    words = F.array(*map(F.lit, first)).cast("array<int>")
    others = F.slice(F.array_except(words, "_centers"), 1, topn)
    more = short.join(base, "words").select(
        "words", F.posexplode(others).alias("pos", "center"), F.round("base", 6).alias("score"), "_centers"
    )
    more = more.withColumn("rank", (F.size("_centers") + F.col("pos") + 1).cast("int")).where(F.col("rank") <= topn)
    return best.select("words", "center", "score", "rank").unionByName(more.select("words", "center", "score", "rank"))


def predict_center(contexts: DataFrame, scores: Scores, topn: int = CANDIDATES) -> DataFrame:
    """Best center words for each (key, context array).

    Candidates are the words counted with at least one context word; every
    other word scores below all of them, so that a context with fewer than
    `topn` candidates is filled up with the first other words. Equal contexts are
    scored once.
    """
    known = durable(_known_contexts(contexts, scores), "contexts")
    best = best_centers(durable(known.select("words").distinct(), "asked"), scores, topn)
    names = scores.words.select(F.col("word").alias("center"), "token")
    return known.join(best, "words").join(names, "center").select("key", F.col("token").alias("center"), "score", "rank")


def _append_allowed(recent: Column, candidates: Column) -> Column:
    """Append each candidate not among the last tokens; the best if none."""

    def step(tokens, candidate):
        last = F.slice(
            tokens,
            F.greatest(F.size(tokens) - RECENT, F.lit(0)) + 1,
            F.lit(RECENT),
        )
        repeated = F.array_contains(last, candidate) & ~candidate.isin(REPEATABLE)
        return F.when(repeated, tokens).otherwise(F.array_append(tokens, candidate))

    extended = F.aggregate(candidates, recent, step)
    return F.when(F.size(extended) > F.size(recent), extended).otherwise(
        F.concat(recent, F.slice(candidates, 1, 1))
    )


def continue_prompts(
    prompts: DataFrame,
    scores: Scores,
    steps: int = STEPS,
) -> DataFrame:
    """Extend every prompt (key, tokens) step by step, all prompts at once.

    A context scored in one step is remembered for all later ones, so that a step
    scores new contexts only. Prompts without a known word stay as they are.
    """
    state = durable(prompts.select("key", "tokens"), "prompts")
    names = scores.words.select(F.col("word").alias("center"), "token")
    ordered = F.array_sort(F.collect_list(F.struct("rank", "token")))
    memo: list[DataFrame] = []
    for _ in range(steps):
        last = F.slice(
            F.col("tokens"), F.greatest(F.size("tokens") - RECENT, F.lit(0)) + 1, F.lit(RECENT)
        )
        known = durable(_known_contexts(state.select("key", last.alias("context")), scores), "contexts")
        asked = known.select("words").distinct()
        for earlier in memo:
            asked = asked.join(earlier, "words", "left_anti")
        asked = durable(asked, "asked")
        if not asked.isEmpty():
            best = best_centers(asked, scores).join(names, "center")
            listed = best.groupBy("words").agg(F.transform(ordered, lambda s: s["token"]).alias("candidates"))
            memo.append(durable(listed, "memo"))
        if memo:
            candidates = known.join(reduce(DataFrame.unionByName, memo), "words")
            state = durable(
                state.join(candidates.select("key", "candidates"), "key", "left").select(
                    "key",
                    F.when(F.col("candidates").isNull(), F.col("tokens"))
                    .otherwise(_append_allowed(F.col("tokens"), F.col("candidates")))
                    .alias("tokens"),
                ),
                "prompts",
            )
    return state
