"""N-gram Jaccard join with adaptive multi-match prefixes.

A document is the set of its distinct word n-grams, each a 64-bit hash. All
documents order their tokens alike: by how many documents hold them, as a
fixed-size sketch over the whole corpus estimates it, then by hash. Two sets
with a similarity of at least t share at least m tokens among the first
p + m - 1 of each, where p = n - ceil(t * n) + 1 and m is any number from 1 on;
of the smaller set the shorter index prefix is enough, where 2 t / (1 + t) takes
the place of t. The join

1. counts tokens of all documents in a sketch of BUCKETS counters;
2. chooses each document's m by its estimated candidate cost, the summed counts
   of its base prefix: the dearer, the longer its prefix and the more shared
   prefix tokens its pairs must show. Documents that hold too few tokens which
   are not hot (boilerplate) also raise their hot tokens, among themselves;
3. collapses equal sets to their smallest document;
4. raises candidates from tokens that two documents hold, the smaller of them in
   its index prefix, among documents of like size. In each such group one
   central document is compared with the others (a group of near copies
   costs as many comparisons as it has members); what is left apart is compared
   again around another centre, and after ROUNDS turns all pairs of the group
   that are still in different components are;
5. counts, on the prefixes alone, the tokens that a raised pair shares, and
   drops it where these are fewer than it must show, or where token counts by
   hash range bound the overlap below the threshold;
6. verifies what is left by the exact similarity of whole sets. Only texts of
   such candidates are read again for their sets.

Every link between different sets that could join two components is verified,
so components are those of the full link graph. The sketch only steers cost.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidrel.llm.common import arrow_rows, byte_blocks, byte_buffer, drop_scratch, mix64, written
from evidrel.llm.graph import components

#: Counters of the token sketch: its size does not depend on the corpus.
BUCKETS = 1 << 20
#: A token whose counter lies so far above the mean is hot: this, or so many roots of the mean (its noise), if that is more.
HOT, NOISE = 64, 6
#: Summed counts above the mean of a base prefix, beyond what noise adds up to, from which two or three matches are asked for.
COSTLY = (2000, 20000)
LONGEST = len(COSTLY) + 1
#: Hash ranges whose token counts bound the overlap of two sets.
RANGES = 64
#: Turns with one centre for each token before all pairs that are left.
ROUNDS = 2

_RNG = np.random.default_rng(20240601)
_BYTE = _RNG.integers(0, 1 << 64, 256, dtype=np.uint64)
_ODD = _RNG.integers(0, 1 << 63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_P = int(_ODD[15])
_P_INVERSE = pow(_P, -1, 1 << 64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int) -> list[np.ndarray]:
    """The sorted distinct n-gram hashes of each text.

    A-Z are lower-cased; words are runs without the characters space and \\t to \\r.
    Fewer than n words make one n-gram of all of them; no word makes an empty set.
    """
    docs = len(offsets) - 1
    low = _LOWER[data]
    inside = ~((low == 32) | ((low >= 9) & (low <= 13)))
    before, after = np.r_[False, inside[:-1]][: len(low)], np.r_[inside[1:], False][: len(low)]
    before[offsets[:-1][offsets[:-1] < len(low)]] = False
    cut = offsets[1:-1] - 1
    after[cut[cut >= 0]] = False
    start, stop = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    # the hash of a word is a polynomial in its bytes, read off running sums
    power = np.full(len(low), _P, np.uint64)
    inverse = np.full(len(low), _P_INVERSE, np.uint64)
    if len(low):
        power[0] = inverse[0] = 1
    np.multiply.accumulate(power, out=power)
    np.multiply.accumulate(inverse, out=inverse)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[low] * power, dtype=np.uint64)])
    word = mix64((sums[stop] - sums[start]) * inverse[start] + (stop - start).astype(np.uint64))
    first = np.searchsorted(start, offsets)
    grams = np.zeros(max(len(word) - n + 1, 0), np.uint64)
    for k in range(n):
        grams += mix64(word[k : k + len(grams)] * _ODD[k] + np.uint64(k))
    grams = mix64(grams)
    out = []
    for d in range(docs):
        lo, hi = first[d], first[d + 1]
        if hi - lo >= n:
            s = np.sort(grams[lo : hi - n + 1])
            out.append(s[np.r_[True, s[1:] != s[:-1]]])
        elif hi > lo:
            few = sum(int(mix64(word[lo + k : lo + k + 1] * _ODD[k + 8])[0]) for k in range(hi - lo)) + int(hi - lo)
            out.append(np.array([few & ((1 << 64) - 1)], dtype=np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def prefix_size(n: int, percent: int) -> int:
    """Tokens of the base prefix: n - ceil(n * percent / 100) + 1."""
    return n - -(-n * percent // 100) + 1


def index_size(n: int, percent: int) -> int:
    """Tokens of the index prefix: n - ceil(n * 2 t / (1 + t)) + 1."""
    return n - -(-n * 2 * percent // (100 + percent)) + 1


def _lists(sets: list[np.ndarray], kind: pa.DataType | None = None) -> pa.Array:
    flat = np.concatenate([np.zeros(0, sets[0].dtype if sets else np.uint64), *sets])
    flat = flat.view(np.int64) if flat.dtype == np.uint64 else flat
    ends = np.cumsum([0, *map(len, sets)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat.astype(kind.to_pandas_dtype()) if kind else flat))


def set_blocks(batch: pa.RecordBatch, n: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """The rows of a batch and their sets, a bounded number of bytes of text at a time."""
    data, offsets = byte_buffer(batch.column("text"))
    for lo, hi in byte_blocks(offsets):
        yield batch.slice(lo, hi - lo), shingle_sets(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], n)


def token_counts(docs: DataFrame, n: int) -> np.ndarray:
    """Over all documents, how many hold a token of each of BUCKETS hash values."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for b in batches:
            for _, sets in set_blocks(b, n):
                total += np.bincount((np.concatenate(sets) % np.uint64(BUCKETS)).astype(np.int64), minlength=BUCKETS)
        parts = total.reshape(64, -1)
        yield pa.record_batch([pa.array(range(64), pa.int32()), pa.array([zlib.compress(x.tobytes(), 1) for x in parts], pa.binary())], names=["part", "counts"])

    def add(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(zlib.decompress(x), np.int64) for x in f["counts"])
        return pd.DataFrame({"part": [key[0]], "counts": [zlib.compress(total.tobytes(), 1)]})

    schema = "part int, counts binary"
    rows = docs.select("text").mapInArrow(count, schema)
    got = rows.withColumn("some", F.pmod(F.xxhash64("counts"), F.lit(16))).groupBy("part", "some").applyInPandas(lambda key, f: add(key, f), schema)
    got = got.groupBy("part").applyInPandas(lambda key, f: add(key, f), schema).orderBy("part").collect()  # 64 rows
    if not got:
        return np.zeros(BUCKETS, np.int64)
    return np.concatenate([np.frombuffer(zlib.decompress(r["counts"]), np.int64) for r in got])


def ordered(s: np.ndarray, excess: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``most`` tokens of a set in the common order, and their counts above the mean."""
    c = excess[(s % np.uint64(BUCKETS)).astype(np.int64)]
    key = (c.astype(np.uint64) << np.uint64(40)) | (s >> np.uint64(24))
    if most < len(s):
        keep = np.argpartition(key, most - 1)[:most]
        # equal keys at the edge are told apart by the whole hash
        edge = key[keep].max()
        keep = np.flatnonzero(key <= edge)
        s, key, c = s[keep], key[keep], c[keep]
    at = np.lexsort((s, key))[:most]
    return s[at], c[at]


def noise(counts: np.ndarray) -> tuple[int, float]:
    """From which excess a token is hot, and the deviation of a counter.

    Both grow with the root of the mean, so that chance makes no token hot and
    no prefix dear in a corpus of any size.
    """
    sd = float(np.sqrt(counts.mean()))
    return max(HOT, int(NOISE * sd)), sd


def adapted(s: np.ndarray, excess: np.ndarray, percent: int, bound: int | None = None, sd: float = 0.0) -> tuple[int, int, bool, np.ndarray, np.ndarray]:
    """Of one set: base prefix length p, m, whether it is boilerplate, its prefix of p + m - 1 tokens, which are hot."""
    if not len(s):
        return 0, 1, False, s, np.zeros(0, bool)
    p = prefix_size(len(s), percent)
    t, c = ordered(s, excess, min(len(s), p + LONGEST - 1))
    hot = c > (HOT if bound is None else bound)
    # the sum of p positive parts of noise is .4 p deviations, give or take .6 of its root
    m = 1 + sum(int(c[:p].sum()) > x + sd * (0.4 * p + 2.5 * p**0.5) for x in COSTLY)
    m = min(m, -(-len(s) * percent // 100))  # a link shares so many tokens at least
    boiler = bool(hot[:p].any())
    while m > 1 and hot[: p + m - 1].any():
        m -= 1
    m = LONGEST if boiler else m
    return p, m, boiler, t[: p + m - 1], hot[: p + m - 1]


def sketches(docs: DataFrame, counts: np.ndarray, n: int, percent: int) -> DataFrame:
    """(doc_id, n, s1, s2, shape, raised, indexed, cold, p, m, boiler).

    n is the size of the set, s1 and s2 are 128 bits of it, shape are its token
    counts by hash range; raised are the prefix tokens that raise candidates, of
    which the first ``indexed`` are in the index prefix and the first ``cold``
    are not hot; p and m are the length of the base prefix and the matches asked
    for. A hot token that boilerplate raises is marked by other bits, so it
    meets only its like.
    """
    excess = docs.sparkSession.sparkContext.broadcast((_excess(counts), *noise(counts)))  # BUCKETS numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        above, bound, sd = excess.value
        for whole in batches:
            for b, sets in set_blocks(whole, n):
                size = np.array([len(s) for s in sets], np.int64)
                s1 = np.array([mix64(s).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)
                s2 = np.array([mix64(s ^ _ODD[14]).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)
                raised, indexed, cold, made = [], [], [], []
                for s in sets:
                    p, m, boiler, t, h = adapted(s, above, percent, bound, sd)
                    marked = np.where(h, t ^ _ODD[13], t)
                    # hot tokens come last in the order; boilerplate raises those of its base prefix only, and all its cold ones are found
                    k, first = int((~h).sum()), index_size(len(s), percent) if len(s) else 0
                    raised.append(marked[: max(k, p)] if boiler else marked)
                    indexed.append(max(first, k) if boiler else first + m - 1)
                    cold.append(k)
                    made.append((p, m, boiler))
                shape = _lists([np.bincount((s >> np.uint64(58)).astype(np.int64), minlength=RANGES) if len(s) else np.zeros(RANGES, np.int64) for s in sets], pa.int32())
                p, m, boiler = zip(*made, strict=True)
                columns = [b.column("doc_id"), pa.array(size), pa.array(s1), pa.array(s2), shape, _lists(raised), pa.array(indexed, pa.int32()), pa.array(cold, pa.int32()), pa.array(p, pa.int32()), pa.array(m, pa.int32()), pa.array(boiler)]
                yield pa.record_batch(columns, names=["doc_id", "n", "s1", "s2", "shape", "raised", "indexed", "cold", "p", "m", "boiler"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, s1 long, s2 long, shape array<int>, raised array<long>, indexed int, cold int, p int, m int, boiler boolean")


def _excess(counts: np.ndarray) -> np.ndarray:
    return np.clip(counts - int(counts.mean()), 0, (1 << 23) - 1).astype(np.int32)


def full_sets(docs: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """(doc_id, grams) of at least the documents in ``wanted`` (doc_id).

    A bitmap of hashed ids, 1 to 16 MB, tells the tasks which texts to read; an
    id that shares its bit with a wanted one is read as well.
    """
    spark = docs.sparkSession
    bits = 1 << min(27, max(23, 4 + wanted.count().bit_length()))
    h = F.pmod(F.xxhash64("doc_id"), F.lit(bits)) + 1
    parts = wanted.select(h.alias("h")).groupBy(F.bitmap_bucket_number("h").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("h")).alias("bits")).collect()
    bitmap = np.zeros(bits // 8 + 4096, np.uint8)
    for r in parts:
        at = (r["k"] - 1) * 4096
        bitmap[at : at + 4096] |= np.frombuffer(bytes(r["bits"]), np.uint8)
    # the number of a bucket and a bit are Spark's own functions of the value, computed there
    shared = spark.sparkContext.broadcast(bitmap)
    rows = docs.select("doc_id", ((F.bitmap_bucket_number(h) - 1) * 32768 + F.bitmap_bit_position(h)).alias("bit"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bit = b.column("bit").to_numpy()
            b = b.filter(pa.array((shared.value[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 1))
            for part, sets in set_blocks(b, n):
                yield pa.record_batch([part.column("doc_id"), _lists(sets)], names=["doc_id", "grams"])

    return rows.mapInArrow(run, "doc_id long, grams array<long>")


def _postings(reps: DataFrame, percent: int) -> DataFrame:
    """(token, size, doc_id, n, index, hot, score): groups of documents that a token and a size may join.

    hot is 0 for a cold token; for a hot one, how many tokens of the document
    are hot: boilerplate has all its cold tokens among those raised, so a pair
    that meets in no cold token shares hot ones at most. A document probes in the group of its size class and of the one below, and
    is found, where the token is in its index prefix, in its own. score: how
    many tokens of a document another one raises too.
    """
    raised = reps.select(F.posexplode("raised").alias("at", "token"), "doc_id", "n", "indexed", "cold")
    # one number holds the size, the number of hot tokens and whether the token is in the index prefix
    hot = F.when(F.col("at") >= F.col("cold"), F.col("n") - F.col("cold")).otherwise(0)
    raised = raised.select("token", "doc_id", (F.shiftleft("n", 33) + hot * 2 + (F.col("at") < F.col("indexed")).cast("long")).alias("x"))
    shared = raised.groupBy("token").agg(F.count(F.lit(1)).alias("k"), F.max(F.col("x") % 2).alias("i")).where("k > 1 and i = 1").select("token")
    live = written(raised.join(shared.hint("merge"), "token"), "live")
    score = live.groupBy("doc_id").agg(F.count(F.lit(1)).alias("score"))
    # classes a little wider than the largest step between the sizes of a pair, so it spans two at most
    own = F.floor(F.log(F.col("n")) / float(-np.log(percent / 100) * (1 + 1e-6))).cast("int")
    rows = live.select("token", "doc_id", F.shiftright("x", 33).alias("n"), (F.col("x") % 2 == 1).alias("index"), F.shiftright("x", 1).bitwiseAND(F.lit((1 << 32) - 1)).alias("hot"))
    rows = rows.withColumn("size", F.explode(F.array(own, own - 1))).withColumn("index", F.col("index") & (F.col("size") == own))
    some = rows.groupBy("token", "size").agg(F.count(F.lit(1)).alias("k"), F.bool_or("index").alias("i")).where("k > 1 and i").select("token", "size")
    out = rows.join(some.hint("merge"), ["token", "size"]).join(score.hint("merge"), "doc_id")
    out = written(out, "postings")
    drop_scratch(live)
    return out


def near_pairs(pairs: DataFrame, shapes: DataFrame, percent: int) -> DataFrame:
    """The raised pairs (a, b) that share enough prefix tokens and whose overlap may be large enough.

    shapes: doc_id, n, shape, raised, p, m, boiler. A pair must show the smaller
    m of its two (two boilerplates: 1) among the first p + m - 1 prefix tokens
    of each; whole sets are not needed for that.
    """
    side = lambda x: shapes.select(F.col("doc_id").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in ("n", "shape", "raised", "p", "m", "boiler")])
    near = pairs.join(side("b").hint("merge"), "b").join(side("a").hint("merge"), "a")
    m = F.when(F.col("boiler_a") & F.col("boiler_b"), 1).otherwise(F.least("m_a", "m_b"))
    cut = lambda x: F.slice(f"raised_{x}", F.lit(1), F.col(f"p_{x}") + m - 1)
    matched = F.size(F.array_intersect(cut("a"), cut("b"))) >= m
    most = F.aggregate(F.zip_with("shape_a", "shape_b", lambda x, y: F.least(x, y)), F.lit(0), lambda s, x: s + x).cast("long")
    return near.where(matched & (most * 100 >= (F.col("n_a") + F.col("n_b") - most) * percent)).select("a", "b")


def _verified(pairs: DataFrame, shapes: DataFrame, docs: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs (a, b) that are similar enough; whole sets are made for documents only that pass near_pairs."""
    near = written(near_pairs(pairs, shapes, percent), "candidates")
    if near.isEmpty():
        return near
    wanted = written(near.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "wanted")
    sets = written(full_sets(docs, wanted, n), "sets")
    side = lambda x: sets.select(F.col("doc_id").alias(x), F.col("grams").alias(f"grams_{x}"))
    whole = near.join(side("b").hint("merge"), "b").join(side("a").hint("merge"), "a")
    both = F.size(F.array_intersect("grams_a", "grams_b"))
    union = F.size("grams_a") + F.size("grams_b") - both
    out = written(whole.where(both * 100 >= union * percent).select("a", "b"), "verified")
    drop_scratch(near, wanted, sets)
    return out


def join_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 3, percent: int = 90) -> DataFrame:
    """(doc_id, n_shingles, class_id, component_id) for every row of docs with an id.

    Documents link when 100 * |intersection| >= percent * |union| of their n-gram
    sets. class_id is the smallest id with the same set, component_id the
    smallest id that links reach. Empty sets link with nothing and are classes
    of their own. Rows that repeat an id count once; rows without an id are
    left out; other columns are not read. A null or empty text is an empty set;
    texts of any length are read whole, a bounded number of bytes at a time.
    Ties need no rule: a link is exact arithmetic on whole numbers. An empty
    table gives an empty table.
    """
    spark = docs.sparkSession
    arrow_rows(spark)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null")
    counts = token_counts(docs, n)
    wide = written(sketches(docs, counts, n, percent), "sketches")
    classes = wide.where("n > 0").groupBy("s1", "s2", "n").agg(F.min("doc_id").alias("class_id"))
    classes = written(classes, "classes")
    reps = wide.select("doc_id", "n", "shape", "raised", "indexed", "cold", "p", "m", "boiler").join(classes.select(F.col("class_id").alias("doc_id")).hint("merge"), "doc_id", "left_semi")
    reps = written(reps, "representatives")
    sketch = written(wide.select("doc_id", "n", "s1", "s2"), "documents")
    drop_scratch(wide)
    postings = _postings(reps, percent)
    groups, shapes = postings.withColumn("comp", F.col("doc_id")), reps.select("doc_id", "n", "shape", "raised", "p", "m", "boiler")

    key, links, comp, old = ["token", "size"], None, None, [reps]
    side = lambda x: groups.select(*key, *[F.col(c).alias(f"{c}_{x}") for c in ("doc_id", "n", "index", "hot", "comp")])
    for turn in range(ROUNDS + 1):
        if turn < ROUNDS:
            # the most central of those that can be found
            best = F.max(F.struct("index", "score", (-F.col("doc_id")).alias("minus"), "n", "hot", "comp")).alias("c")
            centre = groups.groupBy(*key).agg(best).select(*key, (-F.col("c.minus")).alias("doc_id_a"), F.col("c.n").alias("n_a"), F.col("c.index").alias("index_a"), F.col("c.hot").alias("hot_a"), F.col("c.comp").alias("comp_a"))
            pairs = centre.join(side("b").hint("merge"), key)
        else:
            pairs = side("a").where("index_a").join(side("b").hint("merge"), key)
        fits = F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent
        meet = (F.col("index_a") & (F.col("n_a") <= F.col("n_b"))) | (F.col("index_b") & (F.col("n_b") <= F.col("n_a")))
        enough = (F.col("hot_a") == 0) | (F.least("hot_a", "hot_b") * (100 + percent) >= (F.col("n_a") + F.col("n_b")) * percent)
        pairs = pairs.where(fits & meet & enough & (F.col("comp_a") != F.col("comp_b")))
        pairs = pairs.select(F.least("doc_id_a", "doc_id_b").alias("a"), F.greatest("doc_id_a", "doc_id_b").alias("b")).distinct()
        found = _verified(pairs, shapes, docs, n, percent)
        old.append(found)
        links = found if links is None else links.unionByName(found)
        comp = written(components(links), "components")
        if turn < ROUNDS:
            # the centre is done with; what stays are groups whose other members lie in several components
            rest = groups.drop("comp").join(centre.select(*key, "doc_id_a").hint("merge"), key).where("doc_id != doc_id_a").drop("doc_id_a")
            rest = rest.join(comp.hint("merge"), rest["doc_id"] == comp["node"], "left").withColumn("comp", F.coalesce("component", "doc_id")).drop("node", "component")
            apart = rest.groupBy(*key).agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.bool_or("index").alias("i")).where("x != y and i").select(*key)
            groups = written(rest.join(apart.hint("merge"), key), "groups")
            old += [groups, comp]
            if groups.isEmpty():
                break
    out = sketch.select("doc_id", "n", "s1", "s2").join(classes.hint("merge"), ["s1", "s2", "n"], "left").withColumn("class_id", F.coalesce("class_id", "doc_id"))
    out = out.join(comp.hint("merge"), out["class_id"] == comp["node"], "left")
    out = out.select("doc_id", F.col("n").alias("n_shingles"), "class_id", F.coalesce("component", "class_id").alias("component_id"))
    out = written(out.dropDuplicates(["doc_id"]), "joined")
    drop_scratch(sketch, classes, comp, postings, *[t for t in old if t is not comp])
    return out
