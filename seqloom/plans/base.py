"""Registry of queries, each beside its SQL, and the SQL parts they share."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..config import SketchConfig
from ..operators import sketches

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

#: All k-mers of length 9; windows of 42 k-mers, 50 bases apart, 3 smallest hashes each; 14384 bits.
ALL = SketchConfig(k=9, w=9, s=1)
CFG = SketchConfig()


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLE_SQL[name or f.__name__] = sql
        return f

    return add


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dna(spark, sf_dir: str, *keep: str) -> DataFrame:
    return sketches.dna(table(spark, sf_dir, "documents"), "doc_id", "text", *keep)


def flat(spark, sf_dir: str, *keep: str) -> DataFrame:
    return sketches.flat(dna(spark, sf_dir, *keep), ALL, *keep)


def windowed(spark, sf_dir: str, *keep: str) -> DataFrame:
    return sketches.windowed(dna(spark, sf_dir, *keep), CFG, *keep)


def window_counts(spark, sf_dir: str) -> DataFrame:
    """(seq_id, n): windows of every sequence that has any."""
    return windowed(spark, sf_dir).groupBy("seq_id").agg(F.count(F.lit(1)).alias("n"))


def bit_sql(h: str) -> str:
    return f"(xor(3109967720, ({h} * 284019367) & 4294967295) % {ALL.bits})::INT"


DNA = "dna AS (SELECT doc_id AS seq_id, lang, source, upper(regexp_replace(coalesce(text, ''), '[^ACGTacgt]', '', 'g')) AS seq FROM documents)"


def kmer_sql(name: str = "km", k: int = 9, of: str = "dna", rows: str = "") -> str:
    """(seq_id, pos, h, rc) of all k-mers."""
    return f"""{name} AS (SELECT seq_id, lang, source, pos,
  list_sum(list_transform(range(0, {k}), lambda i: (strpos('ACGT', substr(seq, pos + i + 1, 1)) - 1) * (4 ** ({k - 1} - i))::BIGINT))::BIGINT AS h,
  list_sum(list_transform(range(0, {k}), lambda i: (4 - strpos('ACGT', substr(seq, pos + i + 1, 1))) * (4 ** i)::BIGINT))::BIGINT AS rc
  FROM (SELECT seq_id, lang, source, seq, unnest(range(0, greatest(length(seq) - {k - 1}, 0))) AS pos FROM {of}))"""


KM = kmer_sql()
#: Rows (seq_id, window_id, h), three smallest hashes of each window; and windows of each sequence.
WIN = f"""nwin AS (SELECT seq_id, greatest(0, ceil((greatest(length(seq) - 8, 0) - 42) / 50.0))::INT AS n FROM dna),
win AS (SELECT seq_id, lang, source, window_id, h, rn FROM (
  SELECT km.*, (pos // 50)::INT AS window_id, row_number() OVER (PARTITION BY seq_id, pos // 50 ORDER BY h, pos) AS rn
  FROM km JOIN nwin USING (seq_id) WHERE pos % 50 < 42 AND pos // 50 < nwin.n) WHERE rn <= 3)"""
FLAT = f"bits AS (SELECT DISTINCT seq_id, {bit_sql('h')} AS bit FROM km)"
WBITS = f"wbits AS (SELECT DISTINCT seq_id, lang, source, window_id, {bit_sql('h')} AS bit FROM win)"
#: Sequences' flat sizes, and common bits of pairs.
INTER = """cnt AS (SELECT seq_id, count(*) AS n FROM bits GROUP BY 1),
pr AS (SELECT a.seq_id AS i, b.seq_id AS j, count(*) AS c FROM bits a JOIN bits b ON a.bit = b.bit AND a.seq_id < b.seq_id GROUP BY 1, 2),
px AS (SELECT i, j, c, x.n AS na, y.n AS nb FROM pr JOIN cnt x ON x.seq_id = i JOIN cnt y ON y.seq_id = j)"""
WINTER = """wcnt AS (SELECT seq_id, window_id, count(*) AS n FROM wbits GROUP BY 1, 2),
wpr AS (SELECT a.seq_id AS i, b.seq_id AS j, a.window_id, count(*) AS c FROM wbits a JOIN wbits b ON a.bit = b.bit AND a.window_id = b.window_id AND a.seq_id < b.seq_id GROUP BY 1, 2, 3),
wpx AS (SELECT wpr.*, x.n AS na, y.n AS nb FROM wpr JOIN wcnt x ON x.seq_id = i AND x.window_id = wpr.window_id JOIN wcnt y ON y.seq_id = j AND y.window_id = wpr.window_id),
nw AS (SELECT seq_id, n FROM nwin WHERE n > 0)"""
FLAT_ALL = f"WITH {DNA}, {KM}, {FLAT}, {INTER}"
WIN_ALL = f"WITH {DNA}, {KM}, {WIN}, {WBITS}, {WINTER}"
