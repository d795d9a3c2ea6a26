"""Scans, k-mers, minimisers, windows, signatures."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..config import SketchConfig
from ..functions import bloom, kmers, metrics
from ..operators import evaluate, pairs, sketches
from .base import ALL, CFG, DNA, FLAT, KM, WBITS, WIN, bit_sql, dna, flat, kmer_sql, query, table, windowed

CANON_ALL = SketchConfig(k=9, w=9, s=1, canonical=True)
MINI, CANON = SketchConfig(k=4, w=8), SketchConfig(k=4, w=8, canonical=True)
SEEDED = SketchConfig(k=9, w=50, seed=174762)
KM4 = kmer_sql("km4", 4)


def _sliding(source: str, value: str, width: int) -> str:
    """Distinct minima of windows of `width` rows; of all rows where there are fewer."""
    return f"""sl AS (SELECT seq_id, pos, min({value}) OVER (PARTITION BY seq_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND {width - 1} FOLLOWING) AS m, count(*) OVER (PARTITION BY seq_id) AS n FROM {source}),
mins AS (SELECT DISTINCT seq_id, m AS h FROM sl WHERE pos + {width} <= n OR (n < {width} AND pos = 0))"""


@query(f"WITH {DNA} SELECT seq_id, length(seq)::BIGINT AS n_bases, md5(seq) AS digest FROM dna")
def dna_scan(spark, sf_dir: str) -> DataFrame:
    return dna(spark, sf_dir).select("seq_id", F.length("seq").cast("long").alias("n_bases"), F.md5("seq").alias("digest"))


@query(f"WITH {DNA} SELECT (length(seq) // 50 * 50)::INT AS bin, count(*)::BIGINT AS count FROM dna GROUP BY 1")
def dna_length_hist(spark, sf_dir: str) -> DataFrame:
    bins = (F.floor(F.length("seq") / 50) * 50).cast("int").alias("bin")
    return dna(spark, sf_dir).groupBy(bins).agg(F.count(F.lit(1)).alias("count"))


@query("SELECT doc_id AS seq_id, md5(regexp_replace(translate(upper(regexp_replace(coalesce(text, ''), '[^\\x00-\\x7F]', 'A', 'g')), 'URYSWKMBDHVN', 'TACCAGACAAAA'), '[^ACGT]', 'A', 'g')) AS digest FROM documents")
def iupac_coercion(spark, sf_dir: str) -> DataFrame:
    """Texts read as sequences over the IUPAC alphabet."""
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").alias("seq_id"), F.md5(kmers.coerce_dna(F.coalesce("text", F.lit("")))).alias("digest"))


@query(f"WITH {DNA}, {KM} SELECT seq_id, pos::INT AS pos, h FROM km")
def kmers_all(spark, sf_dir: str) -> DataFrame:
    return sketches.kmer_rows(dna(spark, sf_dir), ALL)


@query(f"WITH {DNA}, {KM} SELECT seq_id, pos::INT AS pos, least(h, rc) AS h FROM km")
def kmers_canonical(spark, sf_dir: str) -> DataFrame:
    return sketches.kmer_rows(dna(spark, sf_dir), CANON_ALL)


@query(f"WITH {DNA}, {KM}, s AS (SELECT h, count(*) AS n FROM km GROUP BY 1) SELECT n AS kmer_count, count(*)::BIGINT AS freq FROM s GROUP BY 1")
def kmer_spectrum(spark, sf_dir: str) -> DataFrame:
    """How many distinct k-mers occur so often."""
    counts = sketches.kmer_rows(dna(spark, sf_dir), ALL).groupBy("h").agg(F.count(F.lit(1)).alias("kmer_count"))
    return counts.groupBy("kmer_count").agg(F.count(F.lit(1)).alias("freq"))


@query(f"WITH {DNA}, {KM4} SELECT DISTINCT h, array_to_string(list_transform(range(0, 4), lambda i: substr('ACGT', ((h // (4 ** (3 - i))::BIGINT) % 4 + 1)::BIGINT, 1)), '') AS mer FROM km4")
def mer_strings(spark, sf_dir: str) -> DataFrame:
    return sketches.kmer_rows(dna(spark, sf_dir), SketchConfig(k=4, w=4, s=1)).select("h").distinct().withColumn("mer", kmers.mer(F.col("h"), 4))


@query(f"WITH {DNA}, {kmer_sql('k4', 4)}, g AS (SELECT seq_id, pos, h // 16 * 4 + h % 4 AS v FROM k4) SELECT v AS h, count(*)::BIGINT AS n FROM g GROUP BY 1")
def gapped_kmers(spark, sf_dir: str) -> DataFrame:
    """Counts of the shape 1101."""
    h = kmers.gapped(kmers.codes(F.col("seq")), "1101")
    return dna(spark, sf_dir).select(F.explode(h).alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {DNA}, {KM4}, {_sliding('km4', 'h', 5)} SELECT seq_id, h FROM mins")
def minimisers_distinct(spark, sf_dir: str) -> DataFrame:
    return sketches.minimiser_rows(dna(spark, sf_dir), MINI)


@query(f"WITH {DNA}, {KM4}, {_sliding('km4', 'least(h, rc)', 5)} SELECT seq_id, h FROM mins")
def minimisers_canonical(spark, sf_dir: str) -> DataFrame:
    return sketches.minimiser_rows(dna(spark, sf_dir), CANON)


@query(f"WITH {DNA}, {KM}, {_sliding('km', f'xor(h, {SEEDED.seed})', 42)} SELECT seq_id, h FROM mins")
def minimisers_seeded(spark, sf_dir: str) -> DataFrame:
    return sketches.minimiser_rows(dna(spark, sf_dir), SEEDED)


@query(f"WITH {DNA}, {KM4}, {_sliding('km4', 'h', 5)} SELECT DISTINCT array_to_string(list_transform(range(0, 4), lambda i: substr('ACGT', ((h // (4 ** (3 - i))::BIGINT) % 4 + 1)::BIGINT, 1)), '') AS mer FROM mins")
def minimiser_table(spark, sf_dir: str) -> DataFrame:
    """Distinct minimisers of the whole table, as strings."""
    return sketches.minimiser_rows(dna(spark, sf_dir), MINI).select(kmers.mer(F.col("h"), 4).alias("mer")).distinct()


@query()
def minimiser_emissions(spark, sf_dir: str) -> DataFrame:
    """Every emission of robust winnowing with its place: stateful, so tested against a plain fold."""
    from ..operators.winnowing import emissions

    return emissions(dna(spark, sf_dir), 4, 5)


@query(f"WITH {DNA}, {KM}, {WIN} SELECT seq_id, window_id, string_agg(h::VARCHAR, ',' ORDER BY h) AS hashes FROM win GROUP BY 1, 2")
def window_bottom_s(spark, sf_dir: str) -> DataFrame:
    return sketches.window_rows(dna(spark, sf_dir), CFG).withColumn("hashes", F.array_join("hashes", ","))


@query(f"WITH {DNA}, {KM}, {WIN} SELECT seq_id, window_id, rn::INT AS rank, h FROM win")
def window_partitions(spark, sf_dir: str) -> DataFrame:
    rows = sketches.window_rows(dna(spark, sf_dir), CFG)
    return rows.select("seq_id", "window_id", F.posexplode("hashes").alias("p", "h")).select("seq_id", "window_id", (F.col("p") + 1).alias("rank"), "h")


@query(f"WITH {DNA}, {KM}, {WIN} SELECT seq_id, n FROM nwin")
def window_count_closed_form(spark, sf_dir: str) -> DataFrame:
    return dna(spark, sf_dir).select("seq_id", kmers.n_windows(F.greatest(F.length("seq") - 8, F.lit(0)), CFG.width, CFG.hop).alias("n"))


@query(f"WITH {DNA}, {KM}, {WIN} SELECT seq_id, string_agg(h::VARCHAR, ',' ORDER BY h) AS hashes FROM win WHERE window_id = 0 GROUP BY 1")
def first_window(spark, sf_dir: str) -> DataFrame:
    return sketches.window_rows(dna(spark, sf_dir), CFG).where("window_id = 0").select("seq_id", F.array_join("hashes", ",").alias("hashes"))


@query(f"WITH {DNA}, {KM}, {FLAT} SELECT seq_id, bit FROM bits")
def bloom_bits_flat(spark, sf_dir: str) -> DataFrame:
    return sketches.bit_rows(flat(spark, sf_dir))


@query(f"WITH {DNA}, {KM}, {WIN}, {WBITS} SELECT seq_id, window_id, bit FROM wbits")
def bloom_bits_windowed(spark, sf_dir: str) -> DataFrame:
    return sketches.bit_rows(windowed(spark, sf_dir))


@query(f"WITH {DNA}, {KM}, {WIN}, {WBITS} SELECT DISTINCT seq_id, (window_id % 4)::INT AS window_id, bit FROM wbits")
def bloom_fold_mod(spark, sf_dir: str) -> DataFrame:
    return sketches.folded(windowed(spark, sf_dir), 4)


@query(f"WITH {DNA}, {KM} SELECT DISTINCT source, {bit_sql('h')} AS bit FROM km")
def bloom_per_group(spark, sf_dir: str) -> DataFrame:
    """One signature a source."""
    return sketches.merged(flat(spark, sf_dir, "source"), "source")


@query(f"WITH {DNA}, {KM}, {WIN}, {WBITS} SELECT DISTINCT seq_id, bit FROM wbits")
def bloom_single(spark, sf_dir: str) -> DataFrame:
    """All windows of a sequence in one signature."""
    return sketches.merged(windowed(spark, sf_dir), "seq_id")


@query(f"WITH {DNA}, {KM}, {WIN}, {WBITS} SELECT DISTINCT lang, window_id, bit FROM wbits")
def bloom_by_window_pos(spark, sf_dir: str) -> DataFrame:
    """One signature a language and window."""
    return sketches.merged(windowed(spark, sf_dir, "lang"), "lang", "window_id")


_BENCH = "bdna AS (SELECT item_id AS seq_id, '' AS lang, '' AS source, upper(regexp_replace(coalesce(text, ''), '[^ACGTacgt]', '', 'g')) AS seq FROM benchmark)"
_BKM = kmer_sql("bkm", 9, "bdna")


@query(f"""WITH {DNA}, {KM}, {_BENCH}, {_BKM}, src AS (SELECT DISTINCT source, {bit_sql('h')} AS bit FROM km),
q AS (SELECT DISTINCT seq_id, {bit_sql('h')} AS bit FROM bkm), n AS (SELECT seq_id, count(*) AS n FROM q GROUP BY 1),
hit AS (SELECT q.seq_id, src.source, count(*) AS c FROM q JOIN src USING (bit) GROUP BY 1, 2)
SELECT n.seq_id AS item_id, hit.source, hit.c::BIGINT AS found, n.n::BIGINT AS n, hit.c = n.n AS contained FROM hit JOIN n USING (seq_id)""")
def bloom_contains(spark, sf_dir: str) -> DataFrame:
    """Whether a source's signature contains all bits of a benchmark item, where it has any."""
    sources = sketches.merged(flat(spark, sf_dir, "source"), "source")
    items = sketches.flat(sketches.dna(table(spark, sf_dir, "benchmark"), "item_id", "text"), ALL)
    asked = items.select("seq_id", F.size("bits").cast("long").alias("n"), F.explode("bits").alias("bit"))
    found = asked.join(sources, "bit").groupBy("seq_id", "source", "n").agg(F.count(F.lit(1)).alias("found"))
    return found.select(F.col("seq_id").alias("item_id"), "source", "found", "n", (F.col("found") == F.col("n")).alias("contained"))


@query(f"WITH {DNA}, {KM}, c AS (SELECT seq_id, count(DISTINCT h) AS n FROM km GROUP BY 1) SELECT seq_id, n::BIGINT AS n, round(1 - exp(-n / {ALL.bits}.0), 9) AS rate FROM c")
def bloom_fpp(spark, sf_dir: str) -> DataFrame:
    n = dna(spark, sf_dir).select("seq_id", F.size(F.array_distinct(sketches.hash_array(ALL))).cast("long").alias("n")).where("n > 0")
    return n.withColumn("rate", F.round(bloom.effective_rate(F.col("n"), ALL.bits), 9))


@query(f"WITH {DNA}, {KM}, {FLAT} SELECT DISTINCT seq_id, (bit % 10000 % 5000)::INT AS bit FROM bits")
def bloom_compress(spark, sf_dir: str) -> DataFrame:
    """The table folded to 10000 and then to 5000 bits."""
    return sketches.bit_rows(sketches.compressed(flat(spark, sf_dir), [10000, 5000]))


@query(f"""WITH {DNA}, {KM}, b AS (SELECT DISTINCT lang, {bit_sql('h')} AS bit FROM km), n AS (SELECT lang, count(*) AS n FROM b GROUP BY 1),
c AS (SELECT x.lang AS a, y.lang AS b, count(*) AS c FROM b x JOIN b y ON x.bit = y.bit AND x.lang < y.lang GROUP BY 1, 2)
SELECT a, b, (x.n + y.n - c)::BIGINT AS union_, c::BIGINT AS intersection, (x.n + y.n - 2 * c)::BIGINT AS difference FROM c JOIN n x ON x.lang = a JOIN n y ON y.lang = b""")
def bloom_set_operations(spark, sf_dir: str) -> DataFrame:
    """Union, intersection and symmetric difference of each two languages' signatures."""
    bits = sketches.merged(flat(spark, sf_dir, "lang"), "lang").select(F.col("lang").alias("seq_id"), "bit")
    n = bits.groupBy("seq_id").agg(F.count(F.lit(1)).alias("n"))
    p = pairs.with_sizes(pairs.shared(bits), n)
    na, nb, c = F.col("na"), F.col("nb"), F.col("inter")
    return p.select(F.col("i").alias("a"), F.col("j").alias("b"), metrics.union_size(na, nb, c).alias("union_"), c.alias("intersection"), metrics.hamming(na, nb, c).alias("difference"))


@query(f"WITH {DNA}, {KM}, {WIN} SELECT count(DISTINCT h)::BIGINT AS n FROM win")
def estimate_elements(spark, sf_dir: str) -> DataFrame:
    return sketches.elements(dna(spark, sf_dir), CFG)


@query(f"WITH {DNA}, {KM}, {WIN} SELECT count(DISTINCT h)::BIGINT AS n FROM win WHERE window_id = 0")
def estimate_elements_first_window(spark, sf_dir: str) -> DataFrame:
    return sketches.elements(dna(spark, sf_dir), CFG, all_windows=False)


@query()
def approx_elements(spark, sf_dir: str) -> DataFrame:
    return sketches.elements(dna(spark, sf_dir), CFG, approximate=True)


@query(f"WITH {DNA}, {KM}, {FLAT} SELECT seq_id AS i, count(bit)::BIGINT AS count FROM dna LEFT JOIN bits USING (seq_id) GROUP BY 1")
def count_flat(spark, sf_dir: str) -> DataFrame:
    return sketches.counts(flat(spark, sf_dir)).select(F.col("seq_id").alias("i"), F.col("n").alias("count"))


@query(f"WITH {DNA}, {KM}, {WIN}, {WBITS} SELECT seq_id AS i, count(DISTINCT bit)::BIGINT AS count FROM wbits GROUP BY 1")
def count_union(spark, sf_dir: str) -> DataFrame:
    return sketches.counts(windowed(spark, sf_dir)).select(F.col("seq_id").alias("i"), F.col("n").alias("count"))


@query(f"WITH {DNA}, {KM}, {WIN}, {WBITS}, {FLAT}, a AS (SELECT seq_id, count(*) AS n FROM bits GROUP BY 1), b AS (SELECT seq_id, count(DISTINCT bit) AS n FROM wbits GROUP BY 1) SELECT dna.seq_id AS i, coalesce(a.n, 0)::BIGINT AS flat, b.n::BIGINT AS windowed FROM dna LEFT JOIN a USING (seq_id) LEFT JOIN b USING (seq_id)")
def merge_counts(spark, sf_dir: str) -> DataFrame:
    return evaluate.merge_counts({"flat": count_flat(spark, sf_dir), "windowed": count_union(spark, sf_dir)})
