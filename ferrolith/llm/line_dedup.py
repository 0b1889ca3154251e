"""Line dedup over levelled sorted runs of line hashes.

A run is a table of (key, n_docs, batch), the key being the 128-bit hash of a normalised line and batch the last one
that held it, bucketed and sorted by key.
Batches of documents come one after another. A batch is merge-anti-joined with the runs of frequent keys, those that
enough documents have held already: these are never counted or written again. The rest enters as a new run at level 0
with the number of the batch's documents that hold each key, and what thereby becomes frequent is a new run of frequent
keys. When a level holds `fanout` runs they are merged into one run of the next level, so that a store of any age has
few runs. All runs have the same buckets: merging and joining them shuffles nothing.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrolith.llm.stages import new_path, written

#: The white space that is stripped at the ends of a line.
BLANKS = " \t\n\x0b\x0c\r"
MIN_DOCS = 10
BATCHES = 6
#: Keys (16 bytes, under 100 MB in memory) up to which the frequent ones are broadcast; beyond, they are joined by
#: shuffle, where adaptive execution splits a partition that a very common line makes large.
BROADCAST_KEYS = 1_000_000


def _lowered(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _hex_key(lowered: Column) -> Column:
    plain = F.btrim(lowered, F.lit(BLANKS))
    return F.when(plain != "", F.md5(plain))


def line_key(line: Column) -> Column:
    """128-bit hash of the line stripped of BLANKS at both ends, A-Z in lower case; null for a line of BLANKS."""
    return F.unhex(_hex_key(_lowered(line)))


class LineRuns:
    """A store of runs below one folder of the shared storage, each a bucketed table of the session's catalogue.

    least: documents that make a key frequent. buckets: files of a run, and tasks of a merge; the session's number of
    shuffle partitions if not given.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None, fanout: int = 4, buckets: int | None = None, least: int = MIN_DOCS):
        self.spark, self.folder, self.fanout, self.least = spark, folder or new_path(spark, "line-runs"), fanout, least
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.name = f"line_runs_{uuid.uuid4().hex}"
        self.levels: list[list[str]] = []
        self.frequent_levels: list[list[str]] = []
        self._made = self._batches = 0

    def _write(self, run: DataFrame, levels: list[list[str]], level: int) -> None:
        while len(levels) <= level:
            levels.append([])
        self._made += 1
        name = f"{self.name}_{level}_{self._made}"
        run.write.format("parquet").option("path", f"{self.folder}/{level}-{self._made}").bucketBy(self.buckets, "key").sortBy("key").saveAsTable(name)
        levels[level].append(name)

    def _run(self, name: str) -> DataFrame:
        # the filter, which all rows pass, makes the scan's output rows: a union of columnar bucketed scans counts as
        # bucketed too (Spark 4.1), but does not keep the buckets together
        return self.spark.table(name).where("n_docs > 0")

    def _drop(self, names: list[str]) -> None:
        for name in names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")

    def close(self) -> None:
        """Takes the runs out of the session's catalogue; their files go with stages.clear. Results that still read
        runs must have been written before."""
        for levels in (self.levels, self.frequent_levels):
            for names in levels:
                self._drop(names)
            levels.clear()

    def runs(self) -> list[DataFrame]:
        return [self._run(name) for level in self.levels for name in level]

    def frequent_runs(self) -> list[DataFrame]:
        return [self._run(name) for level in self.frequent_levels for name in level]

    @staticmethod
    def _without(lines: DataFrame, runs: list[DataFrame]) -> DataFrame:
        for run in runs:
            lines = lines.join(run.select("key").hint("merge"), "key", "left_anti")
        return lines

    def add(self, counts: DataFrame) -> None:
        """Adds a batch: one row (key, n_docs) for each key it holds."""
        self._batches += 1
        dealt = counts.select("key", "n_docs", F.lit(self._batches).alias("batch")).repartition(self.buckets, "key")
        self._write(self._without(dealt, self.frequent_runs()), self.levels, 0)
        # what the new run holds is not frequent yet; whether it is now depends on all runs, whose buckets stay
        totals = reduce(DataFrame.unionByName, self.runs()).groupBy("key").agg(F.sum("n_docs").alias("n_docs"), F.max("batch").alias("batch"))
        self._write(totals.where((F.col("n_docs") >= self.least) & (F.col("batch") == self._batches)), self.frequent_levels, 0)
        self.compact()

    def add_batches(self, keys: DataFrame, batches: int) -> None:
        """Adds batches (column batch, from 0, of rows batch, key: one for each document and key) one after another."""
        path = new_path(self.spark, "line-batches")
        keys.groupBy("batch", "key").agg(F.count(F.lit(1)).alias("n_docs")).write.partitionBy("batch").parquet(path)
        counts = self.spark.read.schema("key binary, n_docs bigint, batch int").parquet(path)
        for b in range(batches):  # each reads its own folder alone
            self.add(counts.where(F.col("batch") == b))

    def compact(self) -> None:
        """Merges each full level into one run of the next; counts of keys that are frequent meanwhile are left out."""
        for levels in (self.levels, self.frequent_levels):
            level = 0
            while level < len(levels):
                if len(levels[level]) >= self.fanout:
                    merged = reduce(DataFrame.unionByName, map(self._run, levels[level])).groupBy("key").agg(F.sum("n_docs").alias("n_docs"), F.max("batch").alias("batch"))
                    self._write(self._without(merged, self.frequent_runs()) if levels is self.levels else merged, levels, level + 1)
                    self._drop(levels[level])
                    levels[level] = []
                level += 1

    def frequent(self) -> DataFrame:
        """(key, n_docs) of the keys that at least `least` documents hold, each once; n_docs as of when it became so."""
        runs = self.frequent_runs()
        return reduce(DataFrame.unionByName, runs).select("key", "n_docs") if runs else self.spark.createDataFrame([], "key binary, n_docs bigint")

    def counts(self) -> DataFrame:
        """(key, n_docs) of all keys: of frequent ones as of when they became so, of others over all batches."""
        runs = self.runs()
        if not runs:
            return self.frequent()
        rare = reduce(DataFrame.unionByName, runs).groupBy("key").agg(F.sum("n_docs").alias("n_docs"))
        return self._without(rare, self.frequent_runs()).unionByName(self.frequent())

    def unseen(self, lines: DataFrame) -> DataFrame:
        """The rows of lines (column key) whose key no run holds: a merge anti-join with each run, whose buckets stay."""
        return self._without(lines, self.runs() + self.frequent_runs())


def row_key(*columns: Column) -> Column:
    """A 128-bit identity of a row's values, so that repeated ids with other texts, and null ids, stay apart."""
    return F.unhex(F.md5(F.concat_ws("\x1f", *[F.coalesce(F.concat(F.lit("v"), c.cast("string")), F.lit("n")) for c in columns])))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def drop_lines(docs: DataFrame, frequent: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """docs without the lines whose key is in frequent (column key): text, and n_lines and n_dropped, which replace
    columns so named; other columns stay, whatever their names. Only positions are shuffled, and texts once, to meet
    their positions; keys too where frequent is too large to broadcast."""
    names = docs.columns
    kept_names = [c for c in names if c not in ("n_lines", "n_dropped")]
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    at = {c: f"c{names.index(c)}" for c in kept_names}
    keyed = plain.select(*at.values(), row_key(F.col(at[doc_id]), F.col(at[text])).alias("row"))
    keys = F.transform(_lines(_lowered(F.col(at[text]))), lambda x: F.unhex(_hex_key(x)))
    lines = keyed.select("row", F.posexplode(keys).alias("pos", "key")).where("key is not null")
    if frequent.count() <= BROADCAST_KEYS:
        frequent = F.broadcast(frequent)
    hits = lines.join(frequent, "key", "left_semi").groupBy("row").agg(F.collect_set("pos").alias("drop"))
    joined = keyed.join(hits, "row", "left")
    whole = F.coalesce(F.col(at[text]), F.lit(""))

    def without(ls: Column) -> Column:
        left = F.array_except(F.sequence(F.lit(0), F.size(ls) - 1), F.col("drop"))
        return F.array_join(F.transform(left, lambda i: F.get(ls, i)), "\n")

    # the lines are bound to a variable of a function, as an expression would be split anew for each line
    cut = F.transform(F.array(_lines(F.col(at[text]))), without)[0]
    kept = F.when(F.col("drop").isNull(), whole).otherwise(cut)
    n_lines = F.length(whole) - F.length(F.translate(whole, "\n", "")) + 1
    out = joined.select(*[kept if c == text else F.col(at[c]) for c in kept_names], n_lines.cast("bigint"), F.coalesce(F.size("drop"), F.lit(0)).cast("bigint"))
    return out.toDF(*kept_names, "n_lines", "n_dropped")


def document_keys(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", batches: int = 1) -> DataFrame:
    """(batch, key): one row for each document and each distinct key it holds. Rows of one doc_id are one document; a
    row without doc_id is one of its own, and rows without doc_id of the same text are one. Batches are dealt by
    document."""
    # as strings, whose distinct ones are found by hash; of binary values each would be compared with each
    keys = F.array_compact(F.array_distinct(F.transform(_lines(_lowered(F.col(text))), _hex_key)))
    own = F.when(F.col(doc_id).isNotNull(), F.xxhash64(doc_id)).otherwise(F.xxhash64(F.col(text), F.lit("no id")))
    # all that depends on the text is settled before its lines become rows, which then don't carry it
    held = docs.select(F.pmod(own, F.lit(batches)).cast("int").alias("batch"), F.col(doc_id).alias("doc"), F.when(F.col(doc_id).isNull(), F.xxhash64(text)).alias("other"), keys.alias("keys"))
    held = held.select("batch", "doc", "other", F.explode("keys").alias("key")).withColumn("key", F.unhex("key"))
    return held.distinct().select("batch", "key")


def dedup_lines(docs: DataFrame, min_docs: int = MIN_DOCS, batches: int = BATCHES, runs: LineRuns | None = None) -> DataFrame:
    """docs without the lines that at least min_docs documents hold, n_lines (before) and n_dropped.

    A null text counts as empty: one empty line, which has no key and stays. A line of white space has no key either.
    Rows of one doc_id are one document when documents are counted, but each is cut and returned for itself (see
    document_keys for rows without one). Other lines stay in order, joined by \\n. runs: a store that already holds
    earlier batches, whose counts then count too, and stays open.
    """
    own = runs is None
    runs = LineRuns(docs.sparkSession, least=min_docs) if own else runs
    if runs.least != min_docs:
        raise ValueError("the store counts up to another number of documents")
    runs.add_batches(document_keys(docs, batches=batches), batches)
    frequent = written(runs.frequent().select("key"), "line-frequent")
    if own:
        runs.close()
    return drop_lines(docs, frequent)


def dedup_new_lines(batch: DataFrame, runs: LineRuns) -> DataFrame:
    """A batch without the lines that earlier batches held, and its own keys added to the runs (keep-first dedup of a
    stream of batches; within the batch, repeats stay). The result is bound to the runs as they were before."""
    counts = written(document_keys(batch).groupBy("key").agg(F.count(F.lit(1)).alias("n_docs")), "line-batch")
    known = written(counts.select("key").join(runs.unseen(counts).select("key"), "key", "left_anti"), "line-known")
    out = drop_lines(batch, known)
    runs.add(counts)
    return out


def op1_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP1_SQL = r"""
WITH rows AS (
  SELECT row_number() OVER () AS r, doc_id, text, coalesce('v' || CAST(doc_id AS VARCHAR), 'n' || md5(text)) AS doc FROM documents
), lines AS (
  SELECT r, doc_id, doc, generate_subscripts(ls, 1) AS pos, unnest(ls) AS line
  FROM (SELECT r, doc_id, doc, string_split(coalesce(text, ''), chr(10)) AS ls FROM rows)
), keyed AS (
  SELECT r, doc_id, doc, pos, line,
    regexp_replace(regexp_replace(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', '') AS key
  FROM lines
), frequent AS (
  SELECT key FROM keyed WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc) >= 10
)
SELECT doc_id, count(*) AS n_lines, count(f.key) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE f.key IS NULL), '')) AS kept_sha256
FROM keyed k LEFT JOIN frequent f ON k.key = f.key
GROUP BY r, doc_id
"""
