"""Rules, classifier, languages, URLs, near duplicates."""

import math
import re
import zlib
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from readweave.llm import flat, jaccard, langid, quality, queries, rules, urls, urltable
from tests_llm_brute import brute_components
from tests_llm_data import ODD

D = "/root/testdata/sf0.001"


def brute_rules(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    again = {k + o for k, w in enumerate(windows) if windows.count(w) > 1 for o in range(3)} if len(words) < 3000 else None
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(
        (text or "").count(c) for c in "#*$%&|<>"
    ), len(lines) - len(set(lines)), None if again is None else len(again)


def test_rules(clashing, none):
    got = rules.judge(clashing)
    assert got.columns.count("kept") == 1
    seen = 0
    for r in got.collect():
        want = next(brute_rules(t) for k, t, *_ in ODD if k == r["doc_id"])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"]) == want[:4]
        assert want[4] is None or r["n_repeat_words"] == want[4]
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert not (r["base_failed"] and r["kept"])
        seen += 1
    assert seen == len(ODD) and rules.judge(none).count() == 0


def test_rules_run_without_python(odd):
    plan = rules.judge(odd)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Exchange", plan)


def test_rules_against_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{D}/documents.parquet'")
    want = sorted(con.execute(rules.oracle()).fetchall())
    names = [c[0] for c in con.description]
    assert sorted(tuple(r) for r in queries.op9_quality_rules(spark, D).select(names).collect()) == want


def auc(score, y):
    rank = np.argsort(np.argsort(score))
    return (rank[y == 1].mean() - (y == 1).sum() / 2 + 0.5) / max((y == 0).sum(), 1)


def test_quality(spark):
    d = "/root/testdata/sf0.01"
    got = queries.op3_quality(spark, d).toPandas()
    labels = spark.read.parquet(f"{d}/labels.parquet").toPandas()
    assert len(got) == 1000 and ((got.score >= 0.3) == (got.predicted == 1)).all() and got.score.between(0, 1).all()
    assert (got.held_out == got.doc_id.map(lambda k: zlib.crc32(str(k).encode()) % 5 == 0)).all()
    both = got.merge(labels, on="doc_id")
    both = both[both.held_out]
    assert auc(both.score.to_numpy(), both.quality.to_numpy()) > 0.95
    assert (both.predicted[both.quality == 1] == 1).mean() > 0.95


def test_quality_odd_rows(spark, clashing, none):
    labels = spark.createDataFrame([(1, 1), (2, None), (4, 0), (6, 1), (99, 1), (11, 0), (9, 0), (10, 1), (None, 1)], "doc_id long, quality int")
    model = quality.train(clashing, labels)
    assert quality.score(clashing, model).count() == len(ODD)
    assert quality.score(none, model).count() == 0
    blank = quality.train(none, labels)
    assert {r["predicted"] for r in quality.score(clashing, blank).collect()} == {1}


def test_languages(spark):
    d = "/root/testdata/sf0.01"
    got = queries.op2_language_id(spark, d).toPandas()
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang").toPandas()
    both = got.merge(docs, on="doc_id")
    both = both[both.held_out]
    assert (both.lang_pred == both.lang).mean() > 0.95 and got.score.between(0, 1).all()
    assert both.rejected.mean() < 0.1


def test_languages_odd_rows(clashing, none):
    model = langid.train(clashing)
    got = langid.predict(clashing, model, keep=["doc_id", "text"]).collect()
    assert len(got) == len(ODD)
    for r in got:
        has_letter = any(c.isalpha() for c in r["text"] or "")
        assert (r["lang_pred"] == "und") == (not has_letter)
    assert langid.train(none) is None
    assert {r["lang_pred"] for r in langid.predict(clashing, None).collect()} == {"und"}


def one_hash(data):
    return int(flat.hash_spans(np.frombuffer(data, np.uint8), np.array([0]), np.array([len(data)]))[0])


def test_languages_against_plain_python(spark):
    """Scores are a softmax over the average of the subwords' rows; the sample's order doesn't depend on partitions."""
    docs = spark.read.parquet(f"{D}/documents.parquet")
    model, other = (langid.train(docs.repartition(n)) for n in (3, 7))
    assert (model.table == other.table).all() and (model.bias == other.bias).all() and (model.temperature, model.bar) == (other.temperature, other.bar)
    assert 0 < model.bar < 1
    rows = docs.orderBy("doc_id").limit(12).collect()
    got = {r["doc_id"]: r for r in langid.predict(docs, model, keep=["doc_id"]).collect()}
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for r in rows:
        total, n = [0.0] * len(model.languages), 0
        for word in re.findall(r"[^\x20\x09-\x0D]+", (r["text"] or "").translate(lower)):
            marked = b"<" + word.encode() + b">"
            for part in [marked] + [marked[k : k + size] for size in langid.N for k in range(len(marked) - size + 1)]:
                row = model.table[one_hash(part) % langid.BUCKETS]
                total, n = [t + float(x) for t, x in zip(total, row, strict=True)], n + 1
        if not n or not any(c.isalpha() for c in r["text"]):
            assert got[r["doc_id"]]["lang_pred"] == "und"
            continue
        z = [(t / n + b) / model.temperature for t, b in zip(total, model.bias, strict=True)]
        p = [math.exp(v - max(z)) for v in z]
        assert got[r["doc_id"]]["score"] == pytest.approx(max(p) / sum(p), abs=1e-4)
        assert got[r["doc_id"]]["lang_pred"] == model.languages[p.index(max(p))]


def test_every_language_is_learnt(spark):
    rows = [(k, f"{chr(97 + k % 26)}{chr(97 + k // 26 % 26)} " * 9, f"l{k % 260}") for k in range(1040)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert len(langid.train(df).languages) == 260
    assert len(langid.train(df, sample_entries=300).languages) == 260


def test_samples_are_bounded_by_entries(spark):
    """With many languages of long texts fewer rows of each are taken, so what reaches the driver stays bounded; every language is learnt."""
    rng = np.random.default_rng(4)
    letters = list("abcdefghijklmnopqrstuvwxyz ")
    rows = [(k, "".join(rng.choice(letters, 900)), f"l{k % 300}") for k in range(1800)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    for entries, most in ((10**9, 6), (2_000_000, 3), (1, 1)):
        got = langid.sample(df, sample_entries=entries)
        assert got["lang"].nunique() == 300 and got.groupby("lang").size().max() <= most
        assert got["ids"].map(len).sum() // 4 <= max(entries, 300 * langid.ENTRIES)
    assert len(langid.train(df, sample_entries=500_000).languages) == 300


def test_quality_against_plain_python(spark):
    """A score is a logistic curve over the weighted sum of standardised and binned measures; the sample's order doesn't depend on partitions."""
    docs, labels = spark.read.parquet(f"{D}/documents.parquet"), spark.read.parquet(f"{D}/labels.parquet")
    model, other = (quality.train(docs.repartition(n), labels.repartition(n)) for n in (3, 7))
    assert (model.weights == other.weights).all() and (model.threshold, model.slope) == (other.threshold, other.slope)
    got = {r["doc_id"]: r["score"] for r in quality.score(docs, model, keep=["doc_id"]).collect()}
    measured = quality.scored_vectors(docs, "text", ["doc_id"]).orderBy("doc_id").limit(50).collect()
    m, inner = len(quality.MEASURES), quality.BINS - 1
    for r in measured:
        u = 0.0
        for k, x in enumerate(r["vector"]):
            u += model.weights[k] * min(max((x - model.mean[k]) / model.scale[k], -5), 5)
            u += sum(model.weights[m + k * inner + b] for b in range(inner) if x > model.edges[k][b])
        z = model.slope * (u - model.threshold) + math.log(model.cut / (1 - model.cut))
        assert got[r["doc_id"]] == pytest.approx(1 / (1 + math.exp(-max(min(z, 50), -50))), abs=1e-6)


def test_pairs_rank_what_is_preferred():
    """Bradley-Terry on a measure that alone decides, among noise."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, len(quality.MEASURES)))
    y = (x[:, 4] + 0.1 * rng.normal(size=600) > 0.5).astype(int)
    model = quality.fit(x[:400], y[:400], 1 - y[:400].mean())
    assert auc(model.utility(x[400:]), y[400:]) > 0.97


def test_every_labelled_document_counts(spark):
    """Means, edges and threshold are those of all labelled rows, over several blocks; each row is in a pair."""
    rng = np.random.default_rng(4)
    rows = [(k, " ".join("w" * int(n) for n in rng.integers(1, 9, rng.integers(1, 60)))) for k in range(9300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    labels = docs.selectExpr("doc_id", "cast(length(text) > 90 as int) quality")
    model = quality.train(docs, labels)
    x = np.array([r[1] for r in quality.scored_vectors(docs.where(~quality.held_out("doc_id")), "text", ["doc_id"]).collect()])
    assert np.allclose(model.mean, x.mean(axis=0)) and np.allclose(model.scale, np.where(x.std(axis=0) > 1e-12, x.std(axis=0), 1))
    want = np.quantile(x, np.linspace(0, 1, quality.BINS + 1)[1:-1], axis=0, method="lower").T
    assert np.allclose(model.edges, want)
    y = np.tile([0, 1, 1], 20)
    first, second = quality._paired(0, y, 1, 7)
    assert set(first) | set(second) == set(range(60)) and (y[first] == 1).all() and (y[second] == 0).all()


BAD_HOSTS = [
    "m.casino-win.example.com",
    "free-bets.example.com",
    "m.ads-track.example.com",
    "www.spam-farm.example.com",
    "www.cheap-pills.example.com",
    "blog.adult-x.example.net"
]


def test_labelled_urls():
    """No name of the corpus is learnt; beginnings, ends and bare paths go round alike under both labels; both have rows that the path alone tells."""
    rows = urltable.rows()
    assert len({(h, p) for h, p, _ in rows}) == len(rows)
    corpus = [h.removesuffix(f".example.{end}") for h in BAD_HOSTS for end in ("com", "org", "net") if h.endswith(end)]
    names = {n.removeprefix("www.").removeprefix("m.").removeprefix("blog.") for n in corpus}
    assert names == {"casino-win", "free-bets", "ads-track", "spam-farm", "cheap-pills", "adult-x"}
    assert not [h for h, *_ in rows for n in names if n in h]
    more = urltable.varied(rows)[len(rows) :]
    for label in (0, 1):
        own = [(h, p) for h, p, y in more if y == label]
        for end in (".info", ".net", ".example.org"):
            assert abs(np.mean([h.endswith(end) for h, _ in own]) - 1 / 8) < 0.02 + (end == ".net") / 8
        assert abs(np.mean([h.startswith("www.") for h, _ in own]) - 1 / 6) < 0.02
    hosts = {y: {h.split(".")[0] for h, p, label in rows if label == y and p != "/"} for y in (0, 1)}
    assert len(hosts[0] & hosts[1]) > 20


def test_urls_kept_back():
    """Rows that weren't learnt, the hard ones among them."""
    rows = urltable.rows()
    right = {0: [], 1: []}
    for fold in range(5):
        model, kept = urls.train([r for k, r in enumerate(rows) if k % 5 != fold]), rows[fold::5]
        for (*_, label), p in zip(kept, model.score([r[0] for r in kept], [r[1] for r in kept]), strict=True):
            right[label].append((p >= 0.5) == label)
    assert np.mean(right[1]) > 0.79 and np.mean(right[0]) > 0.9


def test_innocent_hosts_and_bad_paths():
    model = urls.train(urltable.rows())
    assert (model.score(["trackandfield.org", "betsy-baker.com", "essex.example.org", "news.example.com"], ["/a", "/", "/en/1", "/about"]) < 0.5).all()
    assert (model.score(["www.site.example.org", "files.example.org"], ["/casino/poker", "/porn/free-xxx.html"]) >= 0.5).all()
    assert model.score(["x" * 100_000 + ".org"], ["/" + "y" * 100_000]).shape == (1,)


def test_urls_of_unseen_hosts(spark):
    """Bad hosts under good suffixes and the reverse; and all hosts of the corpus."""
    model = urls.train(urltable.rows())
    bad, good = [
        "xxx-videos.example.org",
        "poker-night-casino.com",
        "viagra-online.org",
        "torrent-porn.net"
    ], ["cooking.example", "city-library.net", "universitypress.example", "ththst.example.com"]
    assert (model.score(bad, ["/a"] * 4) >= 0.5).all() and (model.score(good, ["/a"] * 4) < 0.5).all()
    got = urls.judge(
        spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    ).where("host <> ''").select("host", (F.col("score") >= 0.5).alias("blocked")).distinct().collect()
    assert {r["host"] for r in got if r["blocked"]} == set(BAD_HOSTS) and not {r["host"] for r in got if not r["blocked"]} & set(BAD_HOSTS)


def test_urls_against_plain_python():
    model = urls.train(urltable.rows())
    host, path = "www.Some-host.org".lower(), "/En/12é"
    z = model.bias
    for mark, text in ((0, f"^{host}$"), (urls.BUCKETS // 2, path.lower().replace("12", "00") + "$")):
        data = text.encode()
        grams = [data[k : k + n] for n in urls.N for k in range(len(data) - n + 1)]
        z += sum(model.weights[one_hash(g) % urls.BUCKETS ^ mark] for g in grams) / math.sqrt(len(grams))
    assert model.score([host, ""], [path, ""]).tolist() == [pytest.approx(1 / (1 + math.exp(-z))), 0.0]


@pytest.mark.parametrize("url, host, path, rule, verdict", [
    ("http://a.net", "a.net", "", None, "allow"),
    ("http://a.net/", "a.net", "/", "net/", "block"),
    ("https://WWW.Example.NET/en/25#top", "www.example.net", "/en/25", "example.net/en/", "allow"),
    ("https://example.net/fr/?x", "example.net", "/fr/", "net/", "block"),
    ("https://notexample.net/en/1", "notexample.net", "/en/1", "net/", "block"),
    ("http://m.example.com/de/1?a=/de/", "m.example.com", "/de/1", "example.com/de/", "block"),
    ("http://x.org/fr/2", "x.org", "/fr/2", "org/fr/", "allow"),
    ("http://x.org?/fr/2", "x.org", "", None, "allow"),
    ("x.net/en/", "", "", None, "allow"),
    (None, "", "", None, "allow"),
    ("", "", "", None, "allow"),
    ("http://best-online-casino.example/jackpot/win-now", "best-online-casino.example", "/jackpot/win-now", None, "block"),
    ("a://b://c/d", "b:", "//c/d", None, "allow"),
    ("http://x.org?u=http://y.net/z", "x.org", "", None, "allow"),
    ("http://a.net/b\nc?d", "a.net", "/b\nc", "net/", "block"),
])
def test_urls(spark, url, host, path, rule, verdict):
    df = spark.createDataFrame([(1, url, "clash"), (1, url, "clash")], "page_id long, url string, host string")
    for r in urls.judge(df).collect():
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == (host, path, rule, verdict)


def components(df):
    return sorted((tuple(r) for r in jaccard.components(df).collect()), key=str)


def test_near_duplicates_odd_rows(clashing, none):
    assert components(clashing) == brute_components([(k, t) for k, t, *_ in ODD])
    assert components(none) == []


def test_large_groups_meet_in_blocks(spark, monkeypatch):
    """With blocks of few rows every token of a group is dealt over many blocks; links stay the same."""
    monkeypatch.setattr(jaccard, "BLOCK", 3)
    rng = np.random.default_rng(5)
    common, rows = [f"c{k}" for k in range(40)], []
    for k in range(60):  # 40 shared words and a few of their own: some pairs reach the threshold, others just don't
        own = [f"o{k}-{i}" for i in range(rng.integers(0, 9))]
        rows.append((k, " ".join(common + own)))
        rows.append((100 + k, " ".join(common[: rng.integers(20, 40)] + own)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert components(df) == brute_components(rows)


def test_postings_dealt_in_two_steps(spark, monkeypatch):
    """With few postings in a range and few ranges at once, postings go over groups of ranges; links stay the same."""
    monkeypatch.setattr(jaccard, "RANGE", 50)
    monkeypatch.setattr(jaccard, "FAN", 7)
    monkeypatch.setattr(jaccard, "CHUNK", 300)
    rng = np.random.default_rng(8)
    rows = []
    for k in range(60):
        base = [f"w{x}" for x in rng.integers(0, 300, 30)]
        rows += [(3 * k, " ".join(base)), (3 * k + 1, " ".join([*base[:-1], "end"])), (3 * k + 2, " ".join(base[: rng.integers(5, 30)]))]
    assert components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)) == brute_components(rows)


def test_components_have_numbers_of_their_own(spark):
    """Null and repeated keys: the number tells components apart where keys don't."""
    base = [f"w{k}" for k in range(40)]
    rows = [
        (None, " ".join(base)),
        (None, " ".join([*base, "x"])),
        (7, " ".join(base[:39])),
        (7, "another text of seven words in all"),
        (None, None),
        (3, "")
    ]
    got = jaccard.members(spark.createDataFrame(rows, "doc_id long, text string").withColumn("md5", F.md5("text")), carry=("md5",)).collect()
    of = {r["md5"]: (r["doc_id"], r["component_id"], r["component"]) for r in got}
    import hashlib

    digest = lambda t: t and hashlib.md5(t.encode()).hexdigest()
    near = [of[digest(t)] for _, t in rows[:3]]
    assert {c for _, c, _ in near} == {7} and len({n for *_, n in near}) == 1
    assert of[digest(rows[3][1])][:2] == (7, 7) and of[digest(rows[3][1])][2] != near[0][2]
    assert of[None] == (None, None, None) and len(got) == 6


def test_near_duplicates_planted(spark):
    """Exact copies, chains of edits, a passage in many texts, and a group of near copies of one text."""
    rng = np.random.default_rng(1)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 6))
    rows, passage = [], [word() for _ in range(60)]
    for _ in range(30):
        base = [word() for _ in range(rng.integers(3, 120))]
        for _ in range(rng.integers(1, 5)):
            base = list(base)
            for _ in range(rng.integers(0, 3)):
                base[rng.integers(len(base))] = word()
            rows.append(" ".join(base))
    rows += [" ".join([word() for _ in range(rng.integers(2, 40))] + passage) for _ in range(40)]
    hub = [word() for _ in range(100)]
    for _ in range(80):
        own = list(hub)
        for _ in range(rng.integers(0, 6)):
            own[rng.integers(100)] = word()
        rows.append(" ".join(own))
    rows += [rows[0].upper(), rows[0].replace(" ", "\n"), rows[-1]] + [rows[5]] * 40
    keyed = [(int(k), t) for k, t in zip(rng.permutation(len(rows)) - 20, rows, strict=True)]
    assert components(spark.createDataFrame(keyed, "doc_id long, text string").repartition(5)) == brute_components(keyed)


def test_stages_bring_their_folder_to_workers(spark, monkeypatch):
    import corpus_pipeline

    environment = spark.sparkContext.environment
    monkeypatch.setitem(environment, "PYTHONPATH", "/elsewhere")
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    corpus_pipeline.STAGES[0][1](spark, docs, "")
    assert environment["PYTHONPATH"].split(":") == [str(Path(corpus_pipeline.__file__).resolve().parent), "/elsewhere"]
    assert all(hasattr(stage, "__wrapped__") for _, stage in corpus_pipeline.STAGES)
