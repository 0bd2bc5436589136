"""The registered queries: every operator over whole tables, each with its SQL.

Documents serve as pseudo-reads (their ASCII letters mapped to four bases), events
as positioned reads. Sketches have RunConfig's defaults, 250 bands of 3 hashes.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readweave.config import RunConfig
from readweave.functions import kmers, ordinals, sequence
from readweave.operators import evaluate, intervals, lengths, lsh, minhash, shared
from readweave.session import new_folder, spread
from readweave.sources import store, text

K = 16
SKETCH = RunConfig(kmer=K)
CAPPED = RunConfig(kmer=K, max_bucket=3)
LEAST = 0.3
OVERLAP = 20


def documents(spark: SparkSession, d: str) -> DataFrame:
    return spread(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text"))


def reads(spark: SparkSession, d: str) -> DataFrame:
    return sequence.texts_as_reads(documents(spark, d), "doc_id", "text")


def positions(spark: SparkSession, d: str) -> DataFrame:
    events = spark.read.parquet(f"{d}/events.parquet")
    return events.select(
        F.col("event_id").alias("rid"),
        F.expr("unix_micros(cast(ts as timestamp)) div 1000000").alias("rpos"),
        F.ceil("value").cast("long").alias("rlen")
    )


def read_ordinals(spark: SparkSession, d: str) -> DataFrame:
    """Dense ids over all reads; short ones keep theirs but are left out."""
    return ordinals.with_ordinal(
        reads(spark, d).withColumnRenamed("rid", "doc_id"),
        "doc_id",
        "rid"
    ).where(F.length("seq") >= 10).select("rid", "doc_id", F.length("seq").cast("long").alias("len"))


def read_lengths(spark: SparkSession, d: str) -> DataFrame:
    return lengths.lengths(reads(spark, d))


def length_histogram(spark: SparkSession, d: str) -> DataFrame:
    return lengths.histogram(reads(spark, d), 100)


def reverse_complement(spark: SparkSession, d: str) -> DataFrame:
    return reads(spark, d).select("rid", F.md5(sequence.reverse_complement(F.col("seq")).cast("binary")).alias("rc_md5"))


def kmer_windows_count(spark: SparkSession, d: str) -> DataFrame:
    return reads(spark, d).select("rid", F.size(sequence.kmers(F.col("seq"), K)).cast("long").alias("n_kmers"))


def canonical_kmers(spark: SparkSession, d: str) -> DataFrame:
    return kmers.occurrences(reads(spark, d), K)


def kmer_frequency(spark: SparkSession, d: str) -> DataFrame:
    return kmers.tallied(reads(spark, d), K, spell=True)


def kmer_index_stats(spark: SparkSession, d: str) -> DataFrame:
    return shared.index_stats(reads(spark, d), K)


def shared_kmer_pairs(spark: SparkSession, d: str) -> DataFrame:
    return shared.shared_pairs(reads(spark, d), K)


def shared_kmer_counts(spark: SparkSession, d: str) -> DataFrame:
    return shared.shared_counts(reads(spark, d), K)


def kmer_pair_stats(spark: SparkSession, d: str) -> DataFrame:
    """Pairs before and after they are made distinct, and the commonest k-mer."""
    return shared.pair_stats(reads(spark, d), K)


def minhash_signatures(spark: SparkSession, d: str) -> DataFrame:
    return minhash.signatures(reads(spark, d), SKETCH).select("rid", F.posexplode("sig").alias("i", "h")).select("rid", F.col("i").cast("long"), "h")


def _bands(spark: SparkSession, d: str) -> DataFrame:
    return lsh.bands(reads(spark, d), SKETCH)


def lsh_bands(spark: SparkSession, d: str) -> DataFrame:
    return _bands(spark, d).select("rid", F.col("band").cast("long"), lsh.key_text(SKETCH).alias("key"))


def lsh_bucket_sizes(spark: SparkSession, d: str) -> DataFrame:
    return lsh.bucket_sizes(reads(spark, d), SKETCH)


def lsh_band_stats(spark: SparkSession, d: str) -> DataFrame:
    return lsh.band_stats(reads(spark, d), SKETCH).withColumn("band", F.col("band").cast("long"))


def lsh_band_pairs(spark: SparkSession, d: str) -> DataFrame:
    return lsh.bucket_pairs(reads(spark, d), SKETCH).withColumn("band", F.col("band").cast("long"))


def lsh_candidates(spark: SparkSession, d: str) -> DataFrame:
    return lsh.candidates(reads(spark, d), SKETCH)


def lsh_candidates_capped(spark: SparkSession, d: str) -> DataFrame:
    return lsh.candidates(reads(spark, d), CAPPED)


def interval_pairs(spark: SparkSession, d: str) -> DataFrame:
    return intervals.overlap_pairs(positions(spark, d), OVERLAP)


def interval_pairs_uniform(spark: SparkSession, d: str) -> DataFrame:
    return intervals.overlap_pairs(positions(spark, d).withColumn("rlen", F.lit(100).cast("long")), OVERLAP)


def positions_unpivot(spark: SparkSession, d: str) -> DataFrame:
    """Orders as lines of two mates: key and customer as starts."""
    orders = spark.read.parquet(f"{d}/orders.parquet")
    return text.unpivoted(
        ordinals.with_ordinal(orders.select("o_orderkey", "o_custkey"), "o_orderkey", "line").select(
            "line",
            F.col("o_orderkey").alias("left"),
            F.col("o_custkey").alias("right")
        ),
        100
    )


def pair_normalise_distinct(spark: SparkSession, d: str) -> DataFrame:
    items = spark.read.parquet(f"{d}/lineitem.parquet")
    a, b = sequence.normalised(F.col("l_partkey"), F.col("l_suppkey"))
    return items.select(a.alias("a"), b.alias("b")).where("a < b").distinct()


def _sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return lsh_candidates(spark, d), shared.jaccard_pairs(reads(spark, d), K, LEAST)


def pairs_flagged(spark: SparkSession, d: str) -> DataFrame:
    """Candidate and true pairs with where each is found: both differences and the intersection."""
    return evaluate.flagged(*_sides(spark, d))


def pairs_stored(spark: SparkSession, d: str) -> DataFrame:
    """The same from two stores, which are merged bucket by bucket."""
    name = uuid.uuid4().hex
    return evaluate.flagged_stores(*(store.write(side, f"{name}_{k}") for k, side in enumerate(_sides(spark, d))))


def eval_report(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.evaluation(*_sides(spark, d))


def candidate_annotated(spark: SparkSession, d: str) -> DataFrame:
    """Uniform-length pairs judged by the reads' own lengths."""
    return intervals.annotated_uniform(positions(spark, d), 100, OVERLAP)


def _filed(df: DataFrame, name: str) -> str:
    """A folder with a text file for each partition of ``df``, whose only column is the text."""
    folder = new_folder(df.sparkSession, name)
    df.write.text(folder)
    return folder


def fastq_file(spark: SparkSession, d: str) -> DataFrame:
    """All reads written as FASTQ, empty ones too, and read back: ids by place, name, sequence and qualities."""
    named = reads(spark, d).orderBy("rid").select(
        F.concat_ws("\n", F.concat(F.lit("@"), "rid"), "seq", F.lit("+"), F.translate("seq", "ACGT", "@+I#")).alias("value")
    )
    got = text.reads(spark, [_filed(named, "fastq")])
    return got.select("rid", "name", F.md5(F.col("seq").cast("binary")).alias("seq_md5"), F.md5(F.col("qual").cast("binary")).alias("qual_md5"))


def simulated_positions_file(spark: SparkSession, d: str) -> DataFrame:
    """Lines of two mates with blank lines and further tokens between, written and read back as positions."""
    orders = spark.read.parquet(f"{d}/orders.parquet").orderBy("o_orderkey")
    return text.positions(
        spark,
        _filed(orders.select(F.concat_ws(" ", F.lit(" "), "o_orderkey", "o_custkey", F.lit("R\n ")).alias("value")), "meta"),
        100
    )


def mapped_positions_file(spark: SparkSession, d: str) -> DataFrame:
    """Lines of id, position and length, written under a name that ends with ``map`` and read back."""
    folder = f"{new_folder(spark, 'positions')}-map"
    positions(spark, d).select(F.concat_ws("\t", "rid", "rpos", "rlen").alias("value")).write.text(folder)
    return text.positions(spark, folder)


def pairs_file(spark: SparkSession, d: str) -> DataFrame:
    """Pairs written as lines and read back as distinct normalised pairs."""
    folder = new_folder(spark, "pairs")
    text.write_pairs(pair_normalise_distinct(spark, d).selectExpr("b as a", "a as b"), folder)
    return text.pairs(spark, folder)


def lengths_file(spark: SparkSession, d: str) -> DataFrame:
    """The sorted listing of lengths, written and read back with each line's number."""
    folder = new_folder(spark, "lengths")
    text.write_lengths(lengths.lengths(reads(spark, d)), folder)
    return text.numbered_lines(spark, [folder]).select("line", F.col("value").cast("long").alias("len"))


QUERIES: tuple[Callable[[SparkSession, str], DataFrame], ...] = (
    read_ordinals, read_lengths, length_histogram, reverse_complement, kmer_windows_count, canonical_kmers, kmer_frequency, kmer_index_stats,
    shared_kmer_pairs, shared_kmer_counts, kmer_pair_stats, minhash_signatures, lsh_bands, lsh_bucket_sizes, lsh_band_stats, lsh_band_pairs, lsh_candidates,
    lsh_candidates_capped, interval_pairs, interval_pairs_uniform, positions_unpivot, pair_normalise_distinct, pairs_flagged, pairs_stored, eval_report, candidate_annotated,
    fastq_file, simulated_positions_file, mapped_positions_file, pairs_file, lengths_file,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


READS = f"""
    reads AS (
        SELECT doc_id AS rid, translate(upper(regexp_replace(coalesce(text, ''), '[^A-Za-z]', '', 'g')), '{sequence.LETTERS}', '{sequence.AS_BASES}') AS seq
        FROM documents
    )"""

POSTINGS = f"""{READS},
    windows AS (SELECT rid, substr(seq, i, {K}) AS w FROM reads, unnest(range(1, length(seq) - {K} + 2)) AS t(i)),
    posts AS (SELECT rid, least(w, reverse(translate(w, 'ACGT', 'TGCA'))) AS kmer FROM windows)"""

DISTINCT = f"""{POSTINGS},
    one AS (SELECT DISTINCT kmer, rid FROM posts)"""

COUNTS = f"""{DISTINCT},
    counts AS (
        SELECT l.rid AS a, r.rid AS b, count(*) AS n_shared
        FROM one l JOIN one r ON l.kmer = r.kmer AND l.rid < r.rid
        GROUP BY 1, 2
    )"""


def _mixed(x: str, shift: int, factor: int) -> str:
    return f"((xor({x}, {x} >> {shift})::HUGEINT * {factor}::HUGEINT) % {1 << 62}::HUGEINT)::BIGINT"


def _sketches() -> str:
    """The least value of each hash over a read's k-mers, as lists."""
    number = " + ".join(f"(strpos('ACGT', kmer[{i + 1}]) - 1) * {4 ** (K - 1 - i)}" for i in range(K))
    made = minhash.family(SKETCH.bands * SKETCH.block, SKETCH.seed)
    least = ", ".join(f"min(({a} * x + {b}) % {1 << 32}) // 2" for a, b in made)
    return f"""{DISTINCT},
    numbers AS (SELECT rid, ({number})::BIGINT AS x FROM one),
    once AS (SELECT rid, {_mixed("x", 29, kmers.FACTORS[0])} AS x FROM numbers),
    twice AS (SELECT rid, {_mixed("x", 32, kmers.FACTORS[1])} AS x FROM once),
    xs AS (SELECT rid, xor(x, x >> 29) >> 31 AS x FROM twice),
    sigs AS MATERIALIZED (SELECT rid, [{least}] AS sig FROM xs GROUP BY 1)"""


def _banded() -> str:
    key = " || '-' || ".join(f"sig[band * {SKETCH.block} + {j + 1}]" for j in range(SKETCH.block))
    return f"""{_sketches()},
    banded AS MATERIALIZED (SELECT rid, band, {key} AS key FROM sigs, unnest(range(0, {SKETCH.bands})) AS t(band)),
    sizes AS (SELECT band, key, count(*) AS n FROM banded GROUP BY 1, 2),
    met AS (
        SELECT l.band, l.key, l.rid AS a, r.rid AS b
        FROM banded l JOIN banded r ON l.band = r.band AND l.key = r.key AND l.rid < r.rid
    )"""


def _evaluated() -> str:
    return f"""{_banded()},
    {COUNTS.removeprefix(DISTINCT).lstrip(", ")},
    k AS (SELECT rid, count(*) AS size FROM one GROUP BY 1),
    c AS (SELECT DISTINCT a, b FROM met),
    t AS (
        SELECT a, b FROM counts JOIN k x ON x.rid = a JOIN k y ON y.rid = b
        WHERE n_shared >= {LEAST} * (x.size + y.size - n_shared)::DOUBLE
    ),
    f AS (
        SELECT a, b, max(c) AS in_candidate, max(t) AS in_true
        FROM (SELECT a, b, true AS c, false AS t FROM c UNION ALL SELECT a, b, false, true FROM t)
        GROUP BY a, b
    )"""


POSITIONS = "pos AS (SELECT event_id AS rid, epoch_us(ts) // 1000000 AS rpos, ceil(value)::BIGINT AS rlen FROM events)"
UNIFORM = f"""{POSITIONS},
    uni AS (SELECT rid, rpos, 100::BIGINT AS rlen FROM pos)"""


def _meeting(table: str) -> str:
    return f"""
    SELECT DISTINCT least(u.rid, v.rid) AS a, greatest(u.rid, v.rid) AS b
    FROM {table} u JOIN {table} v
        ON u.rid <> v.rid AND u.rpos <= v.rpos AND v.rpos <= u.rpos + u.rlen - {OVERLAP} AND (u.rpos < v.rpos OR u.rid < v.rid)"""


UNPIVOTED = """WITH o AS (
        SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS line, o_orderkey, o_custkey, count(*) OVER () AS n FROM orders
    )
    SELECT line AS rid, o_orderkey AS rpos, 100::BIGINT AS rlen FROM o
    UNION ALL SELECT line + n, o_custkey, 100 FROM o"""
NORMALISED = """SELECT DISTINCT least(l_partkey, l_suppkey) AS a, greatest(l_partkey, l_suppkey) AS b
    FROM lineitem WHERE l_partkey <> l_suppkey"""


def oracle_sql() -> dict[str, str]:
    banded, evaluated = _banded(), _evaluated()
    return {
        "read_ordinals": f"""WITH {READS}, o AS (SELECT row_number() OVER (ORDER BY rid) - 1 AS n, rid AS doc_id, seq FROM reads)
            SELECT n AS rid, doc_id, length(seq)::BIGINT AS len FROM o WHERE length(seq) >= 10""",
        "read_lengths": f"WITH {READS} SELECT rid, length(seq)::BIGINT AS len FROM reads",
        "length_histogram": f"WITH {READS} SELECT (length(seq) // 100 * 100)::BIGINT AS bin, count(*) AS n_reads FROM reads GROUP BY 1",
        "reverse_complement": f"WITH {READS} SELECT rid, md5(reverse(translate(seq, 'ACGT', 'TGCA'))) AS rc_md5 FROM reads",
        "kmer_windows_count": f"WITH {READS} SELECT rid, greatest(length(seq) - {K} + 1, 0)::BIGINT AS n_kmers FROM reads",
        "canonical_kmers": f"WITH {DISTINCT} SELECT kmer, rid FROM one",
        "kmer_frequency": f"WITH {POSTINGS} SELECT kmer, count(*) AS n, count(DISTINCT rid) AS n_reads FROM posts GROUP BY 1",
        "kmer_index_stats": f"""WITH {POSTINGS}, s AS (SELECT kmer, count(*) AS p, count(DISTINCT rid) AS n FROM posts GROUP BY 1)
            SELECT (SELECT count(*) FROM reads) AS n_reads, sum(p)::BIGINT AS n_postings, count(*) AS n_kmers, max(n) AS max_bucket,
                sum(n * (n - 1) // 2)::BIGINT AS n_incidences
            FROM s""",
        "shared_kmer_pairs": f"WITH {COUNTS} SELECT a, b FROM counts",
        "shared_kmer_counts": f"WITH {COUNTS} SELECT a, b, n_shared FROM counts",
        "kmer_pair_stats": f"""WITH {COUNTS}, top AS (SELECT max(n) AS m FROM (SELECT count(*) AS n FROM one GROUP BY kmer))
            SELECT sum(n_shared)::BIGINT AS total_pairs, count(*) AS unique_pairs, (SELECT m FROM top) AS max_bucket FROM counts""",
        "minhash_signatures": f"""WITH {_sketches()}
            SELECT rid, i, sig[i + 1]::BIGINT AS h FROM sigs, unnest(range(0, {SKETCH.bands * SKETCH.block})) AS t(i)""",
        "lsh_bands": f"WITH {banded} SELECT rid, band, key FROM banded",
        "lsh_bucket_sizes": f"WITH {banded} SELECT n, count(*) AS n_buckets FROM sizes GROUP BY 1",
        "lsh_band_stats": f"""WITH {banded},
            counts AS (
                SELECT band, sum(n)::BIGINT AS n_rows, count(*) AS n_buckets, max(n) AS max_bucket, sum(n * (n - 1) // 2)::BIGINT AS n_pairs
                FROM sizes GROUP BY 1
            ),
            firsts AS (SELECT band, count(*) AS new FROM (SELECT a, b, min(band) AS band FROM met GROUP BY 1, 2) GROUP BY 1)
            SELECT band, (SELECT count(*) FROM reads) AS n_reads, n_rows, n_buckets, max_bucket, n_pairs,
                sum(coalesce(new, 0)) OVER (ORDER BY band)::BIGINT AS unique_pairs
            FROM counts LEFT JOIN firsts USING (band)""",
        "lsh_band_pairs": f"WITH {banded} SELECT band, a, b FROM met",
        "lsh_candidates": f"WITH {banded} SELECT DISTINCT a, b FROM met",
        "lsh_candidates_capped": f"WITH {banded} SELECT DISTINCT a, b FROM met JOIN sizes USING (band, key) WHERE n <= {CAPPED.max_bucket}",
        "interval_pairs": f"WITH {POSITIONS} {_meeting('pos')}",
        "interval_pairs_uniform": f"WITH {UNIFORM} {_meeting('uni')}",
        "positions_unpivot": UNPIVOTED,
        "simulated_positions_file": UNPIVOTED,
        "pair_normalise_distinct": NORMALISED,
        "pairs_file": NORMALISED,
        "mapped_positions_file": f"WITH {POSITIONS} SELECT rid, rpos, rlen FROM pos",
        "lengths_file": f"""WITH {READS}
            SELECT row_number() OVER (ORDER BY length(seq)) - 1 AS line, length(seq)::BIGINT AS len FROM reads""",
        "fastq_file": f"""WITH {READS}
            SELECT row_number() OVER (ORDER BY rid) - 1 AS rid, rid::VARCHAR AS name, md5(seq) AS seq_md5, md5(translate(seq, 'ACGT', '@+I#')) AS qual_md5
            FROM reads""",
        "pairs_flagged": f"WITH {evaluated} SELECT a, b, in_candidate, in_true FROM f",
        "pairs_stored": f"WITH {evaluated} SELECT a, b, in_candidate, in_true FROM f",
        "eval_report": f"""WITH {evaluated}, n AS (
                SELECT count(*) FILTER (in_candidate AND NOT in_true) AS cand_only, count(*) FILTER (in_true AND NOT in_candidate) AS true_only,
                    count(*) FILTER (in_candidate AND in_true) AS "both"
                FROM f
            )
            SELECT cand_only, true_only, "both", "both" / nullif("both" + true_only, 0)::DOUBLE AS tp,
                true_only / nullif("both" + true_only, 0)::DOUBLE AS fn, cand_only / nullif("both", 0)::DOUBLE AS fp
            FROM n""",
        "candidate_annotated": f"""WITH {UNIFORM}, p AS ({_meeting("uni")}),
            j AS (
                SELECT p.a, p.b, x.rpos AS a_pos, x.rlen AS a_len, y.rpos AS b_pos, y.rlen AS b_len,
                    CASE WHEN x.rpos < y.rpos OR (x.rpos = y.rpos AND a < b) THEN x.rpos + x.rlen - y.rpos ELSE y.rpos + y.rlen - x.rpos END AS reach
                FROM p JOIN pos x ON x.rid = a JOIN pos y ON y.rid = b
            )
            SELECT a, b, a_pos, a_len, b_pos, b_len, greatest(0, reach) AS overlap, reach >= {OVERLAP} AS is_true FROM j""",
    }
