"""The small fixture of twelve reads with known positions, and edge cases."""

import itertools
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from readweave.config import RunConfig, run_type
from readweave.functions import kmers, ordinals, sequence
from readweave.operators import evaluate, intervals, lengths, lsh, minhash, shared
from readweave.plans import queries, runs
from readweave.sources import store, text

#: Twelve reads and their positions, as the fixture gives them.
READS = """
TTCTGACTGCAACGGGCAATATGTCTCTGTGTGGATTAAAAAAAGAGTGTCTGATAGCAGCTTCTGAACTGGTTACCTGCCGTGAGTAAATTAAAATTTT
CCTAAGCCAATAAAATTTTAATTTACTCACGGCAGGTAACCAGTTCAGAAGCTGCTATCAGACACTCTTTTTTTAATCCACACAGAGACATATTGCCCGT
TCTGTGTGGATTAAAAAAAGAGTGTCTGATAGCAGCTTCTGAACTGGTTACCTGCCGTGAGTAAATTAAAATTTTATTGACTTAGGTCACTAAATACTTT
GTACTCTGTAATTTTTATCTGTCTGTGCGCTATGCCTATATTGGTTAAAGTATTTAGTGACCTAAGTCAATAAAATTTTAATTTACTCACGGCAGGTAAC
TGCCGTGAGTAAATTAAAATTTTATTGACTTAGGTCACTAAATACTTTAACCAATATAGGCATAGCGCACAGACAGATAAAAATTACAGAGTAGACAACA
GTAAATTAAAATTTTATTGACTTAGGTCACTAAATACTTTAACCAATATAGGCATAGCGCACAGACAGATAAAAATTACAGAGTACACAACATCCATGAA
TAAAAATTACAGAGTACACAACATCCATGAAACGCATTAGCACCACCATTACCACCACCATCACCATTACCACAGGTAACGGTGCGGGCTGACGCGTACA
TCCTGTACGCGTCAGCCCGCACCGTTACCTGTGGTAATGGTGATGGTGGTGGTAATGGTGGTGCTAATGCGTTTCATGGATGTTGTGTACTCTGTAATTT
GTACACAACATCCATGAAACGCATTAGCACCACCATTACCACCACCATCACCATTACCACAGGTAACGGTGCGGGCTGACGCGTACAGGAAACACAGAAA
CCTTTGGTCGAAAAAAAAAGCCCGCACTGTCAGGTGCGGGCTTTTTTCTGTGTTTCCTGTACGCGTCAGCCCGCACCGTTACCTGTGGTAATGGTGATGG
AGGTAACGGTGCGGGCTGACGCGTACAGGAAACACAGAAAAAAGCCCGCACCTGACAGTGCGGGCTTTTTTTTTCGACCAAAGGTAACGAGGTAACAACC
TAACGGTGCGGGCTGACGCGTACAGGAAACACAGAAAAAAGCCCGCACCTGACAGTGCGGGCTTTTTTTTTCGACCAAAGGTAACGAGGTAACAACCATG
""".split()
POSITIONS = "9 163\n20 166 R\n\n34 176\n80 220 R P junk\n86 236\n94 239\n"
#: Pairs that overlap by 20 bases, and pairs close enough for any sketch.
TRUE_20 = "0-1 0-2 0-3 0-4 1-2 1-3 1-4 1-5 2-3 2-4 2-5 3-4 3-5 4-5 4-6 4-7 5-6 5-7 6-7 6-8 6-9 6-10 6-11 7-8 7-9 7-10 7-11 8-9 8-10 8-11 9-10 9-11 10-11"
CLOSE = "0-1 0-2 1-2 3-4 3-5 4-5 6-7 6-8 7-8 9-10 9-11 10-11"


def pairs_of(line):
    return {tuple(map(int, p.split("-"))) for p in line.split()}


def got(df):
    return {(r["a"], r["b"]) for r in df.collect()}


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    d = tmp_path_factory.mktemp("reads")
    fastq = lambda rows: "".join(f"@r{k}\n{s}\n+\n{'I' * len(s)}\n" for k, s in enumerate(rows))
    (d / "one.fastq").write_text(fastq(READS[:6]))
    (d / "two.fastq").write_text(fastq(READS[6:]) + "\n")
    (d / "all.fa").write_text("".join(f">r{k}\n{s[:60]}\n{s[60:]}\n" for k, s in enumerate(READS)))
    (d / "meta.txt").write_text(POSITIONS)
    (d / "some.map").write_text("5 0 100 x\n\n1 10 100\n")
    return d


@pytest.fixture(scope="module")
def reads(spark, files):
    return text.reads(spark, [str(files / "one.fastq"), str(files / "two.fastq")]).cache()


@pytest.fixture(scope="module")
def positions(spark, files):
    return text.positions(spark, str(files / "meta.txt")).cache()


def test_reads_keep_file_order(spark, files, reads):
    assert [(r["rid"], r["name"], r["seq"]) for r in reads.orderBy("rid").collect()] == [(k, f"r{k % 6}", s) for k, s in enumerate(READS)]
    fa = text.reads(spark, [str(files / "all.fa")]).orderBy("rid").collect()
    assert [(r["rid"], r["name"], r["seq"]) for r in fa] == [(k, f"r{k}", s) for k, s in enumerate(READS)]


def fastq_text(rows):
    return "".join(f"@{n}\n{s}\n+{n}\n{q}\n" for n, s, q in rows)


@pytest.mark.parametrize("split", ["30b", "150b", "1m"])
def test_fastq_over_split_ends(spark, tmp_path, split):
    """Empty reads, @ and + as first qualities, CR at line ends, blank lines at a file's end, a file given twice; whatever the splits."""
    rng = random.Random(split)
    rows = []
    for k in range(16):
        n = rng.choice([0, 1, 3, 30])
        rows.append((f"r {k}", "".join(rng.choices("acgtn", k=n)), "".join(rng.choices("@+I#", k=n))))
    rows[9] = ("last", "ACG", "@@@")  # its file ends without a line end
    one, two = tmp_path / "one file.fastq", tmp_path / "two.fastq"
    one.write_text(fastq_text(rows[:10]).removesuffix("\n"))
    two.write_bytes(fastq_text(rows[10:]).replace("\n", "\r\n").encode() + b"\n\n")
    (tmp_path / "empty.fastq").write_text("")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        paths = [str(one), str(tmp_path / "empty.fastq"), str(two), str(one)]
        got_ = [(r["rid"], r["name"], r["seq"], r["qual"]) for r in text.fastq(spark, paths).orderBy("rid").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got_ == [(k, n, s.upper(), q) for k, (n, s, q) in enumerate(rows + rows[:10])]


@pytest.mark.parametrize("content, says", [
    ("@a\nAC\n+\nII\nb\nAC\n+\nII\n", "line 5: no @"), ("@a\nAC\n-\nII\n", "line 1: no \\+"), ("@a\nAC\n+\nI\n", "line 1: sequence and qualities"),
    ("@a\nAC\n+\nII\n@b\nAC\n", "line 5 is cut short"), ("@a\n\nAC\n+\nII\n", "cut short"),
])
def test_fastq_that_is_malformed(spark, tmp_path, content, says):
    (tmp_path / "a.fastq").write_text(content)
    with pytest.raises(Exception, match=says):
        text.fastq(spark, [str(tmp_path / "a.fastq")]).collect()


@pytest.mark.parametrize("kind", ["candidate", "kmer", "lengths"])
@pytest.mark.parametrize("content, says", [
    ("x\nACGTACGTAC\n+\nIIIIIIIIII\n", "no @"), ("@x\nACGTACGTAC\n-\nIIIIIIIIII\n", "no \\+"),
    ("@x\nACGTACGTAC\n+\nII\n", "qualities"), ("@x\nACGTACGTAC\n+\n", "cut short"),
])
def test_runs_refuse_malformed_records(spark, tmp_path, kind, content, says):
    """Whatever columns a run reads, a damaged record ends it; the records around are sound."""
    sound = "".join(f"@r{k}\n{s}\n+\n{'I' * len(s)}\n" for k, s in enumerate(READS[:3]))
    (tmp_path / "a.fastq").write_text(sound + content)
    with pytest.raises(ValueError, match=f"line 13.*{says}"):
        runs.main(["-t", kind, str(tmp_path / "a.fastq")], spark)


def test_splits_tell_where_records_begin():
    """At whatever line a split begins, and with @ or + as any first letter of qualities, it finds its records or says that it can't."""
    rng = random.Random(8)
    for first in "@+I":
        lines = []
        for k in range(20):
            n = rng.randrange(1, 6)
            lines += [f"@r{k}", "".join(rng.choices("ACGT", k=n)), "+", first + "".join(rng.choices("@+I", k=n - 1))]
        for at in range(12):
            for n in range(0, 60):
                phase = text._phase(pa.array(lines[at : at + n], pa.string()))
                assert phase == (-at) % 4 or (phase == -1 and n < 11)
    assert text._phase(pa.array(["@a", "+", "@b", "+"] * 9)) == -1  # both ways to frame it are borne out


def test_a_split_gives_out_all_its_lines():
    """Framed lines and loose ones are those that came in, each once, whatever the batches; the first split of a file begins with a record."""
    rng = random.Random(9)
    lines = [x for k in range(40) for x in (f"@r{k}", "ACGT", "+", "@III")]
    for block, at, cut in [(0, 0, 7), (9, 3, 5), (9, 1, 100), (9, 2, 1), (9, 158, 1), (9, 0, 64)]:
        split, out = text._Split((0, 1, block)), []
        own, k = lines[at:], 0
        while k < len(own):
            n = rng.randrange(1, cut + 1)
            out += split.take(pa.array(own[k : k + n]))
            k += n
        seen = [r for b in [*out, *split.end()] for r in b.to_pylist()]
        placed = {}
        for r in seen:
            if r["kind"] == text.RECORD:
                assert r["wrong"] is None and (r["line"] + at) % 4 == 0
                placed |= {r["line"] + f: r[c] for f, c in enumerate(("name", "seq", "plus", "qual"))}
            elif r["kind"] == text.LOOSE:
                placed[r["line"]] = r["name"]
        assert [placed[j] for j in range(len(own))] == own and seen[-1]["line"] == len(own)


def test_text_is_scanned_once(spark, files):
    """Reads come from the table that the one scan of the text wrote."""
    df = text.fastq(spark, [str(files / "one.fastq")])
    assert "text" not in plan and "parquet" in plan


def test_is_sorted(spark):
    df = spark.range(0, 1000, 1, 5)
    assert text.is_sorted(df, "id") and not text.is_sorted(df.selectExpr("-id as id"), "id") and text.is_sorted(df.limit(0), "id")
    assert not text.is_sorted(df.selectExpr("id % 200 as id"), "id")
    assert text.is_sorted(df.selectExpr("id % 7 as id").orderBy("id"), "id")


def test_positions(spark, files, positions):
    rows = sorted((r["rid"], r["rpos"], r["rlen"]) for r in positions.collect())
    assert rows == [(k, p, 100) for k, p in enumerate([9, 20, 34, 80, 86, 94, 163, 166, 176, 220, 236, 239])]
    assert sorted(tuple(r) for r in text.positions(spark, str(files / "some.map")).collect()) == [(1, 10, 100), (5, 0, 100)]


@pytest.mark.parametrize("d, n", [(20, 33), (50, 14), (80, 11)])
def test_true_pairs(positions, d, n):
    found = got(intervals.overlap_pairs(positions, d))
    assert len(found) == n
    if d == 20:
        assert found == pairs_of(TRUE_20)


def test_shared_kmers(reads, positions):
    want = (pairs_of(TRUE_20) - {(4, 7)}) | {(3, 6), (5, 8)}
    assert got(shared.shared_pairs(reads, 16)) == want
    assert len(got(shared.shared_pairs(reads, 8))) == 57 and len(got(shared.shared_pairs(reads, 21))) == 30
    stats = shared.index_stats(reads, 16).first()
    assert (stats["n_reads"], stats["n_postings"], stats["n_kmers"]) == (12, 1020, 329)
    pairs = shared.pair_stats(reads, 16).first()
    counts = [r["n_shared"] for r in shared.shared_counts(reads, 16).collect()]
    assert (
        pairs["unique_pairs"],
        pairs["total_pairs"],
        pairs["max_bucket"]
    ) == (34, sum(counts), stats["max_bucket"]) and sum(counts) == stats["n_incidences"]
    report = evaluate.evaluation(shared.shared_pairs(reads, 16), intervals.overlap_pairs(positions, 20)).first()
    assert (report["cand_only"], report["true_only"], report["both"]) == (2, 1, 32)
    assert report["tp"] == 32 / 33 and report["fn"] == 1 / 33 and report["fp"] == 2 / 32


def test_candidates(reads):
    found = got(lsh.candidates(reads, RunConfig()))
    assert pairs_of(CLOSE) <= found <= got(shared.shared_pairs(reads, 16))
    fewer = got(lsh.candidates(reads, RunConfig(bands=50)))
    assert fewer <= found


def test_registered_setting_finds_weak_overlaps(spark):
    """Pairs of Jaccard similarity of about 0.3: the registered setting finds at least 95 of 100."""
    rng = random.Random(7)
    bases = lambda n: "".join(rng.choices("ACGT", k=n))
    rows = []
    for k in range(100):
        common = bases(150)
        rows += [(2 * k, bases(150) + common), (2 * k + 1, common + bases(150))]
    pairs = spark.createDataFrame(rows, "rid long, seq string")
    true = got(shared.jaccard_pairs(pairs, queries.K, 0.29))
    assert len(true) == 100
    assert len(true & got(lsh.candidates(pairs, queries.SKETCH))) >= 95


def brute_kmers(s, k):
    turn = str.maketrans(sequence.CODES, sequence.COMPLEMENTS)
    return [min(w, w.translate(turn)[::-1]) for w in (s[i : i + k] for i in range(len(s) - k + 1))]


def brute_signature(s, k, made):
    """In whole numbers of any size: a k-mer's number to the base of 4, mixed, under each hash function."""
    xs = set()
    for w in brute_kmers(s, k):
        x = sum("ACGT".index(c) * 4 ** (k - 1 - i) for i, c in enumerate(w))
        for shift, factor in ((29, kmers.FACTORS[0]), (32, kmers.FACTORS[1])):
            x = (x ^ (x >> shift)) * factor % 2**62
        xs.add((x ^ (x >> 29)) >> 31)
    return [min((a * x + b) % 2**32 for x in xs) >> 1 for a, b in made]


def test_registered_setting_against_brute_force(spark, reads):
    made, block, buckets = minhash.family(750, 1), 3, {}
    for k, s in enumerate(READS):
        sig = brute_signature(s, 16, made)
        for band in range(250):
            buckets.setdefault((band, *sig[block * band : block * band + block]), []).append(k)
    pairs = lambda most: {p for rids in buckets.values() if len(rids) <= most for p in itertools.combinations(rids, 2)}
    assert got(lsh.candidates(reads, queries.SKETCH)) == pairs(len(READS))
    assert got(lsh.candidates(reads, queries.CAPPED)) == pairs(3)


def test_strand_and_partitions_do_not_matter(spark, reads):
    turned = reads.withColumn("seq", sequence.reverse_complement(reads["seq"])).repartition(7)
    config = RunConfig(bands=40)
    assert got(lsh.candidates(turned, config)) == got(lsh.candidates(reads, config))
    assert got(shared.shared_pairs(turned, 16)) == got(shared.shared_pairs(reads, 16))


def test_least_hashes_over_chunk_ends(monkeypatch):
    """Rows that lie over several chunks, end with one, or have no fingerprint at all."""
    monkeypatch.setattr(minhash, "CHUNK", 8)
    made, size = minhash.family(5), [3, 0, 20, 1, 0, 8, 8]
    row = np.repeat(np.arange(len(size)), size)
    x = np.random.default_rng(3).integers(0, 1 << 31, len(row)).astype(np.uint64)
    sig = minhash.lowest(x, row, len(size) + 1, np.array(made, np.uint64))
    for r, n in enumerate([*size, 0]):
        own = x[row == r].tolist()
        assert sig[r].tolist() == [min(((a * v + b) % (1 << 32) for v in own), default=(1 << 32) - 1) // 2 for a, b in made], (r, n)


def test_short_and_null_reads_have_no_signature(spark):
    """A read just long enough has one; shorter, empty and null ones and null ids have none."""
    rows = [(1, "ACGTACGTACGTACGT"), (2, "ACGTACGTACGTACG"), (3, ""), (4, None), (None, "ACGTACGTACGTACGT")]
    found = minhash.signatures(spark.createDataFrame(rows, "rid long, seq string"), RunConfig(kmer=16, bands=3))
    assert [r["rid"] for r in found.collect()] == [1]


@pytest.mark.parametrize("block", [2, 3, 4, 5])
def test_signatures_and_bands_against_brute_force(reads, block):
    config = RunConfig(kmer=21, bands=7, block=block)
    want = {k: brute_signature(s, 21, minhash.family(7 * block, 1)) for k, s in enumerate(READS)}
    assert {r["rid"]: list(r["sig"]) for r in minhash.signatures(reads, config).collect()} == want
    keys = {(r["rid"], r["band"]): r["key"] for r in lsh.bands(reads, config).select("rid", "band", lsh.key_text(config).alias("key")).collect()}
    assert keys == {(k, b): "-".join(map(str, sig[b * block : b * block + block])) for k, sig in want.items() for b in range(7)}


@pytest.mark.parametrize("k", [8, 16, 21])
def test_kmers_against_brute_force(spark, monkeypatch, k):
    """Also with other symbols, and for reads that come in several slices."""
    monkeypatch.setattr(kmers, "SLICE", 50)
    rng = random.Random(k)
    rows = [(j, "".join(rng.choices("ACGT", k=n))) for j, n in enumerate((0, 5, k - 1, k, k + 1, 40, 400, 3000))]
    rows += [(20 + j, "".join(rng.choices("ACGTNRY-x", k=n))) for j, n in enumerate((k, 60, 700))] + [(30, None)]
    reads = spark.createDataFrame(rows, "rid long, seq string")
    got = {}
    for r in kmers.postings(reads, k).select("rid", "kmer", kmers.spelled(F.col("kmer"), k).alias("s")).collect():
        got.setdefault(r["rid"], []).append((r["kmer"], r["s"]))
    sizes = {r["rid"]: r["size"] for r in kmers.set_sizes(reads.where("seq is not null"), k).collect()}
    named = {}
    for j, s in rows:
        want = brute_kmers(s or "", k)
        assert len(got.get(j, [])) == len(want) and sizes.get(j, 0) == len(set(want))
        for (number, spelt), w in zip(got.get(j, []), want, strict=True):
            plain = set(w) <= set("ACGT")
            assert spelt == (w if plain else None) and (number >= 0) == plain
            assert named.setdefault(number, w) == w
    assert len(named) == len({w for _, s in rows for w in brute_kmers(s or "", k)})


@pytest.mark.parametrize(("block", "most"), [(4, None), (4, 3), (4, 6), (1000, None)])
def test_buckets_in_blocks(spark, block, most):
    """Buckets of all sizes over many small batches, repeats among them; large ones meet part by part and each pair comes once."""
    from readweave.operators import buckets

    rng = random.Random(block)
    sets = [sorted(rng.sample(range(60), n)) for n in (1, 2, 3, 4, 5, 7, 8, 9, 30, 41) for _ in range(3)]
    sets += [sets[-1], sets[-1], sets[5], sets[5]]
    rows = [(k % 3, k, r) for k, s in enumerate(sets) for r in s for _ in range(rng.choice([1, 1, 2]))]
    rng.shuffle(rows)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        table = buckets.table(spark.createDataFrame(rows, "band int, k0 long, rid long"), ["band", "k0"], most, by_first=True, block=block)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    used = {k: s for k, s in enumerate(sets) if most is None or len(s) <= most}
    made = [(r["k0"], r["a"], r["b"]) for r in buckets.all_pairs(table, ["band", "k0"]).collect()]
    assert sorted(made) == sorted((k, *p) for k, s in used.items() for p in itertools.combinations(s, 2))
    pairs = buckets.pairs(table, ["band", "k0"], {"n": F.count("*")}).groupBy("a", "b").agg(F.sum("n").alias("n")).collect()
    assert {(r["a"], r["b"]): r["n"] for r in pairs} == Counter((a, b) for _, a, b in made)
    lists = table.where(F.col("kind") == buckets.BUCKET).collect()
    assert max((len(r["rids"]) for r in lists), default=0) <= block
    for band, *c in buckets.counts(table).groupBy("band").agg(F.sum("c0"), F.sum("c1"), F.max("c2"), F.sum("c3")).collect():
        own = [s for k, s in enumerate(sets) if k % 3 == band]
        assert c == [sum(map(len, own)), len(own), max(map(len, own)), sum(len(s) * (len(s) - 1) // 2 for s in own if most is None or len(s) <= most)]


def test_equal_buckets_make_their_pairs_once(spark):
    """Copies meet in every band, but their rows are made once, also where a bucket is larger than a block."""
    from readweave.operators import buckets

    rows = [(k, r) for k in range(50) for r in range(20)] + [(99, 3), (99, 4)]
    for block in (1000, 8):
        table = buckets.table(spark.createDataFrame(rows, "kmer long, rid long"), ["kmer"], block=block)
        assert buckets.pairs(table, ["kmer"], {}).count() == 190 + 1


def test_one_sketch_and_one_shuffle_of_rows(spark):
    """The plan that writes the buckets makes windows once and moves rows once."""
    plans, reads = [], spark.createDataFrame(list(enumerate(READS)), "rid long, seq string")
    from readweave.operators import buckets

    written = buckets.written
    try:
        buckets.written = lambda df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or written(df, name)
        lsh.candidates(reads, RunConfig(bands=5)).collect()
        shared.shared_pairs(reads, 16).collect()
    finally:
        buckets.written = written
    for plan in plans:
        initial = plan.split("+- == Initial Plan ==")[-1]
        assert initial.count("Exchange hashpartitioning") == 1 and initial.count("MapInArrow") == 2


def test_no_windows_in_plans(reads):
    for df in (shared.shared_pairs(reads, 16), lsh.candidates(reads, RunConfig(bands=5))):
        assert "Window" not in df._jdf.queryExecution().executedPlan().toString()


def test_found_share_follows_the_curve(spark):
    """Pairs of one Jaccard similarity J meet in some of B bands of T hashes with chance 1 - (1 - J^T)^B."""
    rng = random.Random(11)
    bases = lambda n: "".join(rng.choices("ACGT", k=n))
    rows = []
    for k in range(300):
        common = bases(135)
        rows += [(2 * k, bases(120) + common), (2 * k + 1, common + bases(120))]
    pairs = spark.createDataFrame(rows, "rid long, seq string").cache()
    want = {(2 * k, 2 * k + 1) for k in range(300)}
    j = 120 / (2 * 240 - 120)
    for bands in (5, 20, 60):
        found = len(want & got(lsh.candidates(pairs, RunConfig(bands=bands)))) / 300
        assert found == pytest.approx(1 - (1 - j**3) ** bands, abs=0.09)


def test_fewer_pairs_the_more_must_overlap(positions):
    last = None
    for d in range(10, 100, 15):
        found = got(intervals.overlap_pairs(positions, d))
        assert last is None or found <= last
        last = found


def test_intervals_of_all_lengths_against_brute_force(spark):
    rng = random.Random(2)
    rows = [
        (k, rng.randrange(-3000, 3000), int(rng.choice([30, 100, 129, 1000, 70_000]) * rng.random()) + 1) for k in range(150)
    ] + [(999, -100, 10**9)]
    want = set()
    for (u, up, ul), (v, vp, _) in itertools.permutations(rows, 2):
        if (up < vp or (up == vp and u < v)) and vp <= up + ul - 20 and ul >= 20:
            want.add((min(u, v), max(u, v)))
    df = spark.createDataFrame(rows, "rid long, rpos long, rlen long").repartition(3)
    assert got(intervals.overlap_pairs(df, 20)) == want
    assert got(intervals.overlap_pairs(df.limit(0), 20)) == set()


@pytest.mark.parametrize("starts", ["one", "near", "wide"])
def test_many_reads_at_one_locus(spark, starts):
    """Crowded bins are dealt into blocks: results stay exact, and no place holds more than a few blocks' rows."""
    rng = random.Random(starts)
    spread = {"one": 1, "near": 40, "wide": 4000}[starts]
    rows = [(k, 10_000 + rng.randrange(spread), rng.randrange(25, 35)) for k in range(700)] + [(k, rng.randrange(20_000), rng.choice([50, 9000])) for k in range(700, 760)]
    want = set()
    for u, up, ul in rows:
        want |= {(min(u, v), max(u, v)) for v, vp, _ in rows if (up < vp or (up == vp and u < v)) and vp <= up + ul - 20}
    df = spark.createDataFrame(rows, "rid long, rpos long, rlen long").repartition(3)
    assert got(intervals.overlap_pairs(df, 20, block=50)) == want


def test_places_of_a_crowded_bin_are_small(spark):
    block, n = 100, 20_000
    rows = spark.range(n).selectExpr("id", "pmod(id * 7919, 128) as pos")
    first = rows.selectExpr("id as u", "pos as upos", "pos + 10 as reach", "7 as power", "0L as bin", f"{n}L as n")
    for second in (rows.selectExpr("id as v", "pos as vpos", "7 as power", "0L as bin", f"{n}L as n"), rows.selectExpr("id as v", "5L as vpos", "7 as power", "0L as bin", f"{n}L as n")):
        for side in intervals._dealt(first, second, block):
            assert side.groupBy(*intervals.PLACE).count().agg(F.max("count")).first()[0] < 2 * block


def test_listing_moves_no_single_reads(spark, tmp_path, monkeypatch):
    """Runs of one length over several rows and files; the lines are those of a sort."""
    monkeypatch.setattr(text, "RUN", 7)
    monkeypatch.setattr(text, "FILE_LINES", 40)
    values = [5] * 100 + [3] * 20 + list(range(30)) + [0] * 8
    lengths_ = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "rid long, len long").repartition(3)
    text.write_lengths(lengths_, str(tmp_path / "len"))
    files_ = sorted((tmp_path / "len").glob("part-*"))
    assert [int(x) for f in files_ for x in f.read_text().split()] == sorted(values) and len(files_) > 2
    text.write_lengths(lengths_.limit(0), str(tmp_path / "none"))
    assert not any(f.read_text() for f in (tmp_path / "none").glob("part-*"))


def test_edge_cases_of_intervals(spark):
    df = spark.createDataFrame([(0, 0, 1000), (1, 10, 30), (2, 500, 30), (3, 900, 30)], "rid long, rpos long, rlen long")
    assert got(intervals.overlap_pairs(df, 20)) == {(0, 1), (0, 2), (0, 3)}
    df = spark.createDataFrame([(5, 0, 100), (1, 10, 100), (1, 10, 100), (None, 3, 9)], "rid long, rpos long, rlen long")
    assert got(intervals.overlap_pairs(df, 20)) == {(1, 5)}
    row = intervals.annotated(intervals.overlap_pairs(df, 20), df.dropDuplicates(), 20).first()
    assert row["overlap"] == 90 and row["is_true"]


def test_buckets_and_caps(spark):
    from readweave.operators import buckets

    rows = [(k, 0, 1) for k in range(3)] + [(k, 0, 2) for k in range(3, 7)] + [(8, 0, 3), (9, 0, 3)]
    banded = spark.createDataFrame(rows, "rid long, band int, k0 long")
    keys = ["band", "k0"]
    assert buckets.all_pairs(buckets.table(banded, keys), keys).count() == 3 + 6 + 1
    assert got(buckets.all_pairs(buckets.table(banded, keys, 3), keys)) == {(0, 1), (0, 2), (1, 2), (8, 9)}


def test_band_statistics(spark):
    df = spark.createDataFrame([*((k, READS[0]) for k in range(3)), (3, "ACG"), (4, READS[11]), (5, READS[11])], "rid long, seq string")
    rows = [r.asDict() for r in lsh.band_stats(df, RunConfig(bands=4)).orderBy("band").collect()]
    assert [r["band"] for r in rows] == [0, 1, 2, 3]
    assert all(
        r | {"band": 0} == {"band": 0, "n_reads": 6, "n_rows": 5, "n_buckets": 2, "max_bucket": 3, "n_pairs": 4, "unique_pairs": 4} for r in rows
    )
    capped = lsh.band_stats(df, RunConfig(bands=4, max_bucket=2)).first()
    assert (capped["n_pairs"], capped["unique_pairs"], capped["max_bucket"]) == (1, 1, 3)


def test_short_reads_keep_their_ordinal(spark):
    df = spark.createDataFrame([(0, READS[0]), (1, "ACG"), (2, ""), (3, READS[0])], "rid long, seq string")
    assert got(lsh.candidates(df, RunConfig(bands=5))) == {(0, 3)} == got(shared.shared_pairs(df, 16))


def test_ordinals(spark):
    df = spark.range(0, 1000, 3, 7).withColumnRenamed("id", "x")
    assert sorted(tuple(r) for r in ordinals.with_ordinal(df, "x", "n").select("n", "x").collect()) == [(k, 3 * k) for k in range(334)]


def test_empty_truth_gives_null_ratios(spark):
    none = spark.createDataFrame([], "a long, b long")
    one = spark.createDataFrame([(1, 2)], "a long, b long")
    r = evaluate.evaluation(one, none).first()
    assert (r["cand_only"], r["tp"], r["fp"]) == (1, None, None)


def test_stores_are_compared_without_a_shuffle(spark, files, tmp_path):
    one = spark.createDataFrame([(k, k + 1) for k in range(60)] * 2, "a long, b long").repartition(5)
    two = spark.createDataFrame([(k, k + 1 + k % 2) for k in range(40, 90)], "a long, b long")
    merged = evaluate.flagged_stores(store.write(one, "one", 4), store.write(two, "two", 4))
    want = {tuple(r) for r in evaluate.flagged(one, two).collect()}
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = merged.collect()
        assert len(rows) == len(want) and {tuple(r) for r in rows} == want
        plan = evaluate.flagged_stores(store.read(spark, "one"), store.read(spark, "two"))._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "SortMergeJoin" in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    store.write(two.limit(3), "one", 4)  # in place of the earlier one
    assert store.read(spark, "one").count() == 3
    with pytest.raises(ValueError):
        store.read(spark, "no name")
    fastq = [str(files / "one.fastq"), str(files / "two.fastq")]
    out = runs.main(["-t", "candidate", "-p", str(files / "meta.txt"), "-S", "found", *fastq], spark)
    runs.main(["-t", "true", "-p", str(files / "meta.txt"), "-S", "truth"], spark)
    again = runs.main(["-t", "eval", "-C", "store:found", "-R", "store:truth"], spark)
    assert {k: again[k] for k in ("both", "cand_only", "true_only")} == {k: out[k] for k in ("both", "cand_only", "true_only")}


def test_lengths(reads):
    assert [tuple(r) for r in lengths.histogram(reads, 100).collect()] == [(100, 12)]


def test_limits():
    for bad in ({"kmer": 7}, {"kmer": 22}, {"block": 1}, {"block": 6}, {"bands": 1000}, {"max_bucket": 0}):
        with pytest.raises(ValueError):
            RunConfig(**bad)
    with pytest.raises(ValueError):
        run_type("other")


def test_command_line(spark, files, tmp_path):
    fastq = [str(files / "one.fastq"), str(files / "two.fastq")]
    assert runs.main(["-t", "true", "-p", str(files / "meta.txt"), "-O", str(tmp_path / "true")], spark)["pairs"] == 33
    out = runs.main(["-t", "candidate", "-p", str(files / "meta.txt"), "-O", str(tmp_path / "cand"), *fastq], spark)
    assert out["both"] + out["cand_only"] == out["pairs"]
    again = runs.main(["-t", "eval", "-C", str(tmp_path / "cand"), "-R", str(tmp_path / "true")], spark)
    assert {k: again[k] for k in ("both", "cand_only", "true_only")} == {k: out[k] for k in ("both", "cand_only", "true_only")}
    assert runs.main(["-t", "kmer", *fastq], spark)["pairs"] == 34
    counted = runs.main(["-t", "kmer", "-s", *fastq], spark)
    assert counted["unique_pairs"] == 34 <= counted["total_pairs"] and set(counted["phases"]) == {"read_files", "compute_hash", "sort_records", "pair_gen", "statistics"}
    listed = runs.main(["-t", "lengths", "-w", "30", "-O", str(tmp_path / "len"), *fastq], spark)
    assert listed["reads"] == 12 and listed["histogram"] == {90: 12}
    lines = [x for f in sorted((tmp_path / "len").glob("part-*")) for x in f.read_text().split()]
    assert lines == sorted(lines, key=int) and len(lines) == 12
    bands = runs.main(["-t", "candidate", "-s", "-B", "6", "-a", "-p", str(files / "meta.txt"), "-O", str(tmp_path / "placed"), *fastq], spark)
    assert len(bands["bands"]) == 6 and bands["bands"][-1]["unique_pairs"] == bands["pairs"]
    placed = spark.read.csv(str(tmp_path / "placed"), sep=" ", header=True, inferSchema=True)
    assert placed.count() == bands["pairs"] and placed.where("is_true").count() == bands["both"] and placed.where("is_true and overlap < 20").isEmpty()
    with pytest.raises(ValueError):
        runs.main(["-t", "candidate", "-a", *fastq], spark)
    with pytest.raises(ValueError):
        runs.main(["-t", "candidate"], spark)


def test_uniform_pairs_carry_positions_and_are_not_shuffled(spark):
    rows = [(k, 7 * k % 300, 20 + k % 150) for k in range(120)] + [(3, 5, 90), (3, 40, 10), (200, None, 50), (4, None, 60)]
    df = spark.createDataFrame(rows, "rid long, rpos long, rlen long")
    uniform = intervals.overlap_pairs(df.withColumn("rlen", F.lit(100).cast("long")), 20)
    columns = ["a", "b", "a_pos", "a_len", "b_pos", "b_len", "overlap", "is_true"]
    want = sorted(map(tuple, intervals.annotated(uniform, df, 20).select(columns).collect()), key=str)
    assert want and sorted(map(tuple, intervals.annotated_uniform(df, 100, 20).select(columns).collect()), key=str) == want
    assert len(uniform.collect()) == len(got(uniform))
    once = df.where("rid > 4 and rpos is not null")
    met = intervals.overlap_pairs(once, 20)
    met.collect()
    final = met._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "hashpartitioning(a" not in final


def test_tallies_and_occurrences_of_odd_reads(spark, monkeypatch):
    monkeypatch.setattr(kmers, "TALLIED", 40)
    rng = np.random.default_rng(5)
    seq = lambda n: "".join(rng.choice(list("ACGT"), n))
    same = seq(30)
    rows = [(1, same), (2, same * 3), (2, same), (2, same[5:]), (3, ""), (4, "A" * 60), (5, same[:20] + "N" + same), (None, same), (-6, seq(40))]
    reads = spark.createDataFrame(rows, "rid long, seq string")
    for k in (9, 16, 21):
        each = kmers.postings(reads, k).groupBy("kmer", "rid").agg(F.count("*").alias("n"))
        want = each.groupBy("kmer").agg(F.sum("n").alias("n"), F.count("*").alias("n_reads"))
        assert sorted(map(tuple, kmers.tallied(reads, k).collect())) == sorted(map(tuple, want.collect()))
        text = want.select(kmers.spelled(F.col("kmer"), k), "n", "n_reads")
        assert sorted(map(tuple, kmers.tallied(reads, k, spell=True).collect()), key=str) == sorted(map(tuple, text.collect()), key=str)
        text = each.select(kmers.spelled(F.col("kmer"), k), "rid")
        assert sorted(map(tuple, kmers.occurrences(reads, k).collect()), key=str) == sorted(map(tuple, text.collect()), key=str)
    assert not kmers.tallied(reads.limit(0), 16).collect() and not kmers.occurrences(reads.limit(0), 16).collect()
    plan = kmers.occurrences(reads.where("rid <> 2"), 16)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_kmers_of_a_long_read_come_once(monkeypatch):
    monkeypatch.setattr(kmers, "SLICE", 50)
    texts = ["ACGTTGCAAC" * 5, "ACGTTGCAAC" * 40, "ACGN" * 60, "ACG", "ACG" * 10]
    found = sorted((r, x, n) for row, kmer, many in kmers._once(pa.array(texts), 16) for r, x, n in zip(row.tolist(), kmer.tolist(), many.tolist()))
    monkeypatch.setattr(kmers, "SLICE", 1 << 19)
    windows = Counter((r + lo, x) for lo, kmer, row in kmers.slices(pa.array(texts), 16) for r, x in zip(row.tolist(), kmer.tolist()))
    assert found == sorted((*key, n) for key, n in windows.items())


def test_texts_become_bases_in_numpy(spark):
    """As Spark's expression has them, over several windows; also nulls, texts without letters and letters beyond ASCII. The expression isn't run where reads are sketched."""
    odd = ["", None, "x", "12 -", "Grüße, ÄÖ Straße", "ſK İı", "日本 abc 😀Z", "\x00a\x7fB@[`{", "AZaz" * 300]
    texts = spark.createDataFrame([(k, odd[k % len(odd)]) for k in range(20_010)], "doc_id long, text string").coalesce(1)
    reads = sequence.texts_as_reads(texts, "doc_id", "text")
    want = dict(reads.collect())
    column = pa.array([odd[k % len(odd)] for k in range(20_012)]).slice(0, 20_010)
    got = [(lo + j, s) for lo, hi, seq in sequence.bases(column) for j, s in enumerate(seq.to_pylist())]
    assert len(got) == len(want) and dict(got) == want
    config = RunConfig(bands=3, kmer=8)
    plain = reads.select("rid", "seq", F.lit(1).alias("texts"))
    assert got_rows(lsh.bands(reads, config)) == got_rows(lsh.bands(plain, config))
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "translate" in plan(lsh.bands(plain, config)) and "translate" not in plan(lsh.bands(reads, config))


def got_rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_sizes_of_buckets_move_packed(spark, monkeypatch):
    """Keys that repeat in a batch, over batches and over tasks, and keys that differ in one column; what moves are groups, not rows of bands."""
    from readweave.operators import buckets

    monkeypatch.setattr(buckets, "SENT", 40)
    rng = random.Random(5)
    rows = [(rng.choice([0, 249]), rng.choice([0, 5, (1 << 62) - 1, -7]), rng.randrange(3), r) for r in range(900)] + [(7, 7, 7, r) for r in range(500)]
    rows += [(1, k, 0, k) for k in range(300)]
    want = Counter(Counter(r[:3] for r in rows).values())
    keys = "band int, k0 long, k1 long, rid long"
    assert dict(buckets.sizes(spark.createDataFrame(rows, keys).repartition(5), ["band", "k0", "k1"]).collect()) == want
    assert buckets.sizes(spark.createDataFrame([], keys), ["band", "k0", "k1"]).collect() == []
    df = spark.createDataFrame([(k, READS[k % len(READS)]) for k in range(60)], "rid long, seq string")
    config = RunConfig(bands=9)
    own = Counter(Counter(tuple(r) for r in lsh.bands(df, config).drop("rid").collect()).values())
    sizes = lsh.bucket_sizes(df, config)
    assert dict(sizes.collect()) == own
    plan = sizes._jdf.queryExecution().executedPlan().toString().split("+- == Initial Plan ==")[-1]
    assert "hashpartitioning(grp" in plan and "hashpartitioning(band" not in plan


def test_tallied_groups_hold_each_key_once(monkeypatch):
    """Hashes that collide keep keys apart; groups come once each, in order."""
    from readweave.operators import buckets, frequent

    rng = np.random.default_rng(2)
    columns = [rng.integers(0, 3, 5000), rng.integers(-4, 1 << 61, 5000) // (1 << 59), rng.integers(0, 5, 5000)]
    want = Counter(zip(*(c.tolist() for c in columns)))
    names = ["grp", "size", *(f"{x}{k}" for k in range(4) for x in ("least", "above"))]
    for hashed in (frequent._hash, lambda keys: (keys[0] % 2).astype(np.uint64) << np.uint64(61)):
        monkeypatch.setattr(frequent, "_hash", hashed)
        batch = buckets._tallied(columns, names)
        group = batch.column(0).to_pylist()
        assert group == sorted(set(group)) and max(group) < buckets.TALLIES
        found = Counter()
        for *own, n in buckets._unpacked(iter([batch]), 4):
            for *key, many in zip(*(c.tolist() for c in own), n.tolist()):
                found[tuple(key)] += many
        assert found == want


def test_kmers_of_all_lengths():
    rng = random.Random(8)
    texts = ["".join(rng.choices("ACGT", k=n)) for n in (0, 7, 30, 61)]
    buf, at = np.frombuffer("".join(texts).encode(), np.uint8), np.r_[0, np.cumsum([len(s) for s in texts])]
    for k in range(8, 22):
        number, row = kmers.packed(buf, at, k)
        assert [(int(r), s) for r, s in zip(row, kmers.letters(number, k).to_pylist())] == [(r, w) for r, s in enumerate(texts) for w in brute_kmers(s, k)]
