"""Line dedup: levelled sorted runs of line hashes.

Documents are dealt into batches by a hash of the id. A batch's line keys are
reduced to one row each and merge-anti-joined with the runs: keys that no run
holds are new and become the batch's own sorted run (h1, h2, n_docs, keeper);
keeper is the largest id with the line. What a batch holds of known keys goes
to a second set of runs, of gains, which hold no key first. When a level holds
``fanout`` runs they are compacted into one sorted run of the next level: keys
are put together as they are, since they differ from run to run, gains of a key
add up. At the end every key stands in one run, once; its gains are added to it.

Everything is DataFrame code. A line key travels as two 64-bit hashes; counts
are reduced in each task before they are shuffled, so a line that a third of all
documents hold reaches its reducer as one row for each task. The repeated keys
are a table of their own before they meet the lines again, so that Spark can
split the lines of a hot key.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidrel.llm.common import drop_path, scratch

#: The white space that a line key loses at both ends.
SPACE = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Documents of a batch at most.
BATCH_DOCS = 50_000_000


def lines(text: str | Column) -> Column:
    """The lines of a text, split at \\n; null or empty: one empty line."""
    c = F.col(text) if isinstance(text, str) else text
    return F.split(F.coalesce(c, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    """A line without white space at both ends, A-Z in lower case."""
    return F.translate(F.trim(line, F.lit(SPACE)), UPPER, LOWER)


def long_lines(text: str | Column, min_chars: int) -> Column:
    """(pos, h1, h2) of the lines whose key has at least min_chars code points; 128 bits stand for a key."""
    keys = F.transform(lines(text), lambda x, i: F.struct(i.alias("pos"), line_key(x).alias("k")))
    hashes = lambda x: F.struct(x["pos"].alias("pos"), F.xxhash64(x["k"]).alias("h1"), F.xxhash64(F.lit("line"), x["k"], F.length(x["k"])).alias("h2"))
    return F.transform(F.filter(keys, lambda x: F.length(x["k"]) >= min_chars), hashes)


@dataclass
class LineRuns:
    """The levels of sorted runs, in the folder that all executors share: of keys, and of what known keys gained."""

    spark: SparkSession
    fanout: int = 3
    levels: list[list[str]] = field(default_factory=list)
    gained: list[list[str]] = field(default_factory=list)

    SCHEMA = "h1 long, h2 long, n_docs long, keeper long"

    def _write(self, run: DataFrame) -> str:
        path = scratch(self.spark, "line-run")
        run.sortWithinPartitions("h1", "h2").write.parquet(path)
        return path

    def _all(self, levels: list[list[str]]) -> DataFrame:
        paths = [p for level in levels for p in level]
        return self.spark.read.schema(self.SCHEMA).parquet(*paths) if paths else self.spark.createDataFrame([], self.SCHEMA)

    @staticmethod
    def _summed(gains: DataFrame) -> DataFrame:
        return gains.groupBy("h1", "h2").agg(F.sum("n_docs").alias("n_docs"), F.max("keeper").alias("keeper"))

    def keys(self) -> DataFrame:
        """Every key, once, with the count and the keeper of the batch that brought it."""
        return self._all(self.levels)

    def add(self, batch: DataFrame) -> None:
        """Adds a batch (doc_id, h1, h2); the rows of an id all lie in one batch."""
        path = self._write(batch.groupBy("h1", "h2").agg(F.count_distinct("doc_id").alias("n_docs"), F.max("doc_id").alias("keeper")))
        if not self.levels:
            return self._push(self.levels, 0, path)
        own, known = self.spark.read.schema(self.SCHEMA).parquet(path), self.keys().select("h1", "h2").hint("merge")
        fresh, again = self._write(own.join(known, ["h1", "h2"], "left_anti")), self._write(own.join(known, ["h1", "h2"], "left_semi"))
        drop_path(self.spark, path)
        self._push(self.levels, 0, fresh)
        self._push(self.gained, 0, again)

    def _push(self, levels: list[list[str]], level: int, path: str) -> None:
        while len(levels) <= level:
            levels.append([])
        levels[level].append(path)
        if len(levels[level]) >= self.fanout:
            full, levels[level] = levels[level], []
            run = self._all([full])
            self._push(levels, level + 1, self._write(run.repartition("h1", "h2") if levels is self.levels else self._summed(run)))
            for p in full:
                drop_path(self.spark, p)

    def compacted(self) -> DataFrame:
        """(h1, h2, n_docs, keeper): how many ids hold each key, and the largest of them."""
        more = self._summed(self._all(self.gained)).select("h1", "h2", F.col("n_docs").alias("more"), F.col("keeper").alias("larger"))
        out = self.keys().join(more.hint("merge"), ["h1", "h2"], "left")
        return out.select("h1", "h2", (F.col("n_docs") + F.coalesce("more", F.lit(0))).alias("n_docs"), F.greatest("keeper", "larger").alias("keeper"))

    def drop(self) -> None:
        for p in [p for level in [*self.levels, *self.gained] for p in level]:
            drop_path(self.spark, p)
        self.levels, self.gained = [], []


def index_lines(docs: DataFrame, min_chars: int, batches: int, fanout: int) -> tuple[LineRuns, str]:
    """Runs over all lines of docs (doc_id, t, text), and the path of the table (doc_id, t, pos, h1, h2, batch) of their keys.

    The lines are written once, dealt by a hash of the id into ``batches``
    batches or as many as BATCH_DOCS asks for; each batch then reads its own
    files only.
    """
    spark = docs.sparkSession
    path = scratch(spark, "line-keys")
    batches = max(batches, -(-docs.count() // BATCH_DOCS))
    batch = F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int")
    keys = docs.where("doc_id is not null").select("doc_id", "t", F.explode(long_lines("text", min_chars)).alias("k"), batch.alias("batch"))
    keys.select("doc_id", "t", "k.pos", "k.h1", "k.h2", "batch").write.partitionBy("batch").parquet(path)
    runs = LineRuns(spark, fanout)
    for b in range(batches):
        runs.add(line_keys(spark, path).where(F.col("batch") == b))
    return runs, path


def line_keys(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("doc_id long, t long, pos int, h1 long, h2 long, batch int").parquet(path)


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5, batches: int = 3, fanout: int = 3) -> DataFrame:
    """docs with columns n_lines, n_dropped and kept_text added.

    A key of at least ``min_chars`` code points that at least ``min_docs``
    different ids hold loses all its lines except in the largest id that holds
    it. Other lines stay, joined by \\n. Defined results: a null or empty text
    has one empty line and keeps it; a text of which no line stays becomes
    empty; a row with a null id counts for nothing and keeps all its lines; rows
    that repeat an id count once and each loses its lines, or keeps them, as
    that id does; an empty table gives an empty table; other columns pass
    through, but one named like an added column is replaced.
    """
    spark = docs.sparkSession
    made = {"n_lines", "n_dropped", "kept_text"}
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in made]).alias("row"),
        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(F.coalesce(text_col, F.lit(""))).alias("t"),
    )
    runs, path = index_lines(rows.select("doc_id", "t", "text"), min_chars, batches, fanout)
    repeated_path, doomed_path = scratch(spark, "line-repeated"), scratch(spark, "line-doomed")
    runs.compacted().where(F.col("n_docs") >= min_docs).select("h1", "h2", "keeper").write.parquet(repeated_path)
    runs.drop()
    repeated = spark.read.schema("h1 long, h2 long, keeper long").parquet(repeated_path)
    # the places of the lines that a row loses; t tells apart rows that repeat an id
    hits = line_keys(spark, path).select("doc_id", "t", "pos", "h1", "h2").join(repeated.hint("merge"), ["h1", "h2"]).where("doc_id != keeper")
    hits.groupBy("doc_id", "t").agg(F.collect_set("pos").alias("doomed")).write.parquet(doomed_path)
    drop_path(spark, path)
    drop_path(spark, repeated_path)
    doomed = spark.read.schema("doc_id long, t long, doomed array<int>").parquet(doomed_path)
    out = rows.join(doomed.hint("shuffle_hash"), ["doc_id", "t"], "left")
    stays = lambda ls: F.transform(F.array_except(F.sequence(F.lit(0), F.size(ls) - 1), F.col("doomed")), lambda i: F.get(ls, i))
    kept = F.array_join(F.get(F.transform(F.array(lines("text")), stays), F.lit(0)), "\n")
    return out.select(
        "row.*", F.size(lines("text")).cast("long").alias("n_lines"), F.coalesce(F.size("doomed"), F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("doomed").isNull(), F.coalesce("text", F.lit(""))).otherwise(kept).alias("kept_text"),
    )
