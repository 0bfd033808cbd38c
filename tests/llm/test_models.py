"""Language id, toxicity and the co-trained classifier: accuracy on rows that were not learned from, and odd inputs."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.llm import common, cotrain, langid, toxicity

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


def test_language_of_pages_and_documents(spark, docs):
    model = langid.train(docs.where(~common.held_out(F.col("doc_id"))))
    got = langid.identify(langid.document_records(docs.where(common.held_out(F.col("doc_id")))), model).join(docs.select("doc_id", F.col("lang").alias("truth")), "doc_id").toPandas()
    assert (got.lang == got.truth).mean() > 0.97
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = langid.identify(langid.page_records(pages), model).join(pages.select("page_id", F.regexp_extract("url", r"example\.\w+/(\w\w)/", 1).alias("truth")), "page_id").toPandas()
    assert len(got) == pages.count() and (got.lang == got.truth).mean() > 0.97


def test_host_and_declaration_decide_where_the_text_says_little(spark, docs):
    model = langid.train(docs)
    german = docs.where("lang = 'de'").limit(30).select("text").collect()
    rows = [(i, f"http://www.x.de/{i}", f'<html lang="de"><p>{r.text}</p></html>') for i, r in enumerate(german)]
    rows += [(100, "http://www.x.de/e", ""), (101, "http://other.org/", None), (102, None, '<html lang="DE-at"></html>'), (None, "not a url", "<p>"), (100, "http://www.x.de/e", "")]
    got = langid.identify(langid.page_records(spark.createDataFrame(rows, "page_id long, url string, html string")), model).collect()
    by = {r.page_id: r for r in got}
    assert len(got) == len(rows) and by[100].lang == "de" and by[102].lang == "de" and by[101].text_lang is None
    assert all(0 < r.confidence <= 1 for r in got)
    assert langid.identify(langid.page_records(spark.createDataFrame([], "page_id long, url string, html string")), model).collect() == []
    none = langid.train(docs.withColumn("lang", F.lit(None).cast("string")))
    assert none is None and langid.identify(langid.document_records(docs.limit(3)), None).first().lang is None


def test_host_prior_by_hand(spark):
    """Two hosts of one domain: a page without text follows its host, not the other."""
    logp = np.log(np.full((langid.BUCKETS, 2), 1 / langid.BUCKETS))
    logp[langid.buckets(["aaaa"])[0][1:3], 0] += 50
    logp[langid.buckets(["bbbb"])[0][1:3], 1] += 50
    rows = [(i, "http://one.x.com/", "aaaa" * 20) for i in range(9)] + [(20 + i, "http://two.x.com/", "bbbb" * 20) for i in range(9)] + [(50, "http://one.x.com/", ""), (51, "http://two.x.com/", "")]
    got = {r.page_id: r for r in langid.identify(langid.page_records(spark.createDataFrame(rows, "page_id long, url string, html string")), (["xa", "xb"], logp.astype(np.float32))).collect()}
    assert got[50].lang == "xa" and got[51].lang == "xb"
    domain = (9 + 5 * 0.5) / (18 + 5)  # what the domain gives either language
    host = (9 + 5 * domain) / (9 + 5)
    assert got[50].confidence == pytest.approx(host / (host + (0 + 5 * domain) / 14), rel=0.05)


def plain_identify(records, names, logp):
    """(lang, confidence) of (body, is_html, declared, host) records, one after another by the rule of the docstring."""
    def grams(text):
        raw = f" {text.lower()} ".encode()
        return [((raw[i] << 16 | raw[i + 1] << 8 | raw[i + 2]) * 0x9E3779B1 % (1 << 32)) >> 16 for i in range(len(raw) - 2)]

    n, rows = len(names), []
    for body, web, declared, host in records:
        text = langid.visible(body) if web else body or ""
        ll = [sum(logp[g][k] for g in grams(text)) / 3 if text.strip() else 0.0 for k in range(n)]
        e = [math.exp(x - max(ll)) for x in ll]
        post = [x / sum(e) for x in e] if text.strip() else [0.0] * n
        parts = (host or "").split(".")
        rows.append((ll, post, declared, host, parts[-1] if len(parts) > 1 else None, ".".join(parts[-2:]) if len(parts) > 1 else None))
    total = lambda keep: [sum(r[1][k] for r in rows if keep(r)) for k in range(n)]
    world = [x + 1 for x in total(lambda r: True)]
    share = [x / sum(world) for x in world]

    def likelihood(at, value):
        if value is None:
            return [0.0] * n
        seen = total(lambda r: r[at] == value)
        return [math.log((s + sum(seen) / sum(world) + 1e-9) / (w + 1)) for s, w in zip(seen, world)]

    def drawn(at, value, post, prior):
        if value is None:
            return prior
        left = [max(0.0, s - p) for s, p in zip(total(lambda r: r[at] == value), post)]
        return [(x + 5 * q) / (sum(left) + 5) for x, q in zip(left, prior)]

    out = []
    for ll, post, declared, host, suffix, domain in rows:
        prior = drawn(3, host, post, drawn(5, domain, post, share))
        z = [a + b + c + math.log(q) for a, b, c, q in zip(ll, likelihood(2, declared), likelihood(4, suffix), prior)]
        out.append((names[z.index(max(z))], 1 / sum(math.exp(x - max(z)) for x in z)))
    return out


@pytest.mark.parametrize("hot", [1, 1000])
def test_fusion_against_a_plain_version(spark, docs, monkeypatch, hot):
    """Every kind of evidence, ties, repeats, very long and empty texts, clashing names; hosts by broadcast and by shuffle."""
    monkeypatch.setattr(langid, "HOT", hot)
    names, logp = langid.train(docs)
    texts = [r.text for r in docs.where("n_chars < 300").limit(12).collect()]
    rng = random.Random(4)
    rows = []
    for i in range(60):
        body = rng.choice([*texts, "", None, "ja", "der", "the " * 30_000])
        web = rng.random() < 0.6
        rows.append((i, None, f"<p>{body or ''}</p>" if web else body, web, rng.choice([None, "de", "en", "xx"]), rng.choice([None, "plain", "a.x.de", "b.x.de", "c.org"])))
    rows.append(rows[5])
    ddl = "doc_id long, page_id long, body string, is_html boolean, declared string, host string"
    got = sorted(langid.identify(spark.createDataFrame(rows, ddl).withColumns({"__h": F.lit(1), "post": F.lit("x"), "records": F.lit(2)}).repartition(3), (names, logp)).collect(), key=lambda r: r.doc_id)
    want = plain_identify([r[2:] for r in sorted(rows, key=lambda r: r[0])], names, logp.astype(float))
    assert [r.lang for r in got] == [w[0] for w in want]
    assert [r.confidence for r in got] == pytest.approx([w[1] for w in want], rel=1e-3)


def test_texts_never_read_their_neighbours(spark, docs):
    h, sizes = langid.buckets(["ja", "", "x yz"])
    assert sizes.tolist() == [2, 0, 4] and h[:2].tolist() == langid.buckets(["ja"])[0].tolist() and h[2:].tolist() == langid.buckets(["x yz"])[0].tolist()
    model = langid.train(docs)
    short = [(i, x) for i, x in enumerate(["ja", "und", "of the", "le", "ja", ""] * 5)]
    ddl = "doc_id long, text string, source string"
    frames = [spark.createDataFrame([(*r, None) for r in rows], ddl).repartition(k) for rows, k in ((short, 1), (short[::-1], 4))]
    a, b = ({r.doc_id: (r.lang, round(r.confidence, 9)) for r in langid.identify(langid.document_records(f), model).collect()} for f in frames)
    assert a == b


def test_every_language_has_a_model(spark):
    """More languages than 64, one of them hot and each of the others in two documents."""
    rng = random.Random(9)
    codes = ["".join((a, b)) for a in "abcdefghij" for b in "klmnopq"]
    word = lambda k: "".join(chr(0x1000 + 40 * k + rng.randrange(12)) for _ in range(5))
    rows = [(i, codes[max(i - 200, 0) // 2], " ".join(word(max(i - 200, 0) // 2) for _ in range(40)), "host") for i in range(200 + 2 * len(codes))]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string, source string")
    names, logp = langid.train(docs)
    assert names == codes and np.exp(logp.astype(float)).sum(axis=0) == pytest.approx(np.ones(len(codes)), abs=1e-3)
    for i, code, text, _ in rows[200::7]:
        assert names[logp[langid.buckets([text])[0]].sum(axis=0).argmax()] == code


def test_toxicity_separates_held_out_rows(spark):
    """Planted expressions among invented words; stems with endings never seen are caught by their parts."""
    rng = random.Random(3)
    part = ["ba", "de", "ki", "lo", "mu", "ne", "so", "ta", "ri"]
    word = lambda: "".join(rng.choice(part) for _ in range(rng.randrange(1, 5)))
    rows, marks = [], []
    for i in range(1500):
        text = [word() for _ in range(rng.choice([20, 100, 400]))]
        toxic = i % 6 == 0
        if toxic:
            for _ in range(3):
                text.insert(rng.randrange(len(text)), rng.choice(["vexcrub", "gruffow"]) + rng.choice(part) + rng.choice(part))
        rows.append((i, " ".join(text)))
        marks.append((i, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    fitted = toxicity.train(docs, spark.createDataFrame(marks, "doc_id long, toxic int"))
    got = {r.doc_id: r for r in toxicity.score(docs, fitted).collect()}
    held = [i for i in range(1500) if got[i].held_out]
    assert 200 < len(held) < 400
    wrong = [i for i in held if got[i].predicted != int(i % 6 == 0)]
    assert len(wrong) <= 0.02 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values())


def test_toxicity_counts_rare_expressions(spark):
    """Each expression stands in two toxic documents at most; those that gave counts speak for toxicity, and so do their parts."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice(["ba", "de", "ki", "lo", "mu", "ne"]) for _ in range(rng.randrange(1, 4)))
    rare = [f"{a}zq{b}vyx" for a in "cfghp" for b in "rtwj"]
    rows = [(i, " ".join([word() for _ in range(30)] + ([rare[i // 10 % 20]] if i % 10 == 0 else []))) for i in range(400)]
    marks = [(i, int(i % 10 == 0)) for i, _ in rows]
    model, _, _ = toxicity.train(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, toxic int"))
    found = [w for w in rare if np.isin(toxicity.grams([w])[0], model.levels[-1].keys).all()]
    assert len(found) >= 12  # the others are held out or set the curve
    per_byte = lambda words: np.divide(*model.evidence(words))
    assert (per_byte(found) > 0.3).all() and (per_byte([w + "ba" for w in found]) > 0.1).all()


def test_toxicity_of_ordinary_words_together(spark):
    """An expression of two words, each as frequent in ordinary documents: only the pair tells."""
    rng = random.Random(8)
    pool = ["".join(rng.choice("abcdefghij") for _ in range(4)) for _ in range(40)]
    rows, marks = [], []
    for i in range(900):
        text = [w for w in (rng.choice(pool) for _ in range(60)) if w not in ("green", "goat")]
        toxic = i % 5 == 0
        for k in range(0, 60, 12):
            text[k:k] = ["green", "goat"] if toxic else rng.choice([["green", pool[k % 40], "goat"], ["goat", "green"]])
        rows.append((i, " ".join(text)))
        marks.append((i, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    fitted = toxicity.train(docs, spark.createDataFrame(marks, "doc_id long, toxic int"))
    got = [r for r in toxicity.score(docs, fitted).collect() if r.held_out]
    assert sum(r.predicted != int(r.doc_id % 5 == 0) for r in got) <= 0.03 * len(got)


def plain_kneser_ney(counts, text, order=7, discount=0.75):
    """log P of the last byte of *text* after the others, by dictionaries; *counts* of n-grams of full length."""
    def continuation(k):
        lower = Counter()
        for g in {x[-k - 1 :] for x in counts}:
            lower[g[1:]] += 1
        return lower

    table = {order: Counter(counts)} | {k: continuation(k) for k in range(1, order)}

    def p(g):
        if not g:
            return 1 / 256
        own = {x: n for x, n in table[len(g)].items() if x[:-1] == g[:-1] and n > 0}
        total = sum(own.values())
        if not total:
            return p(g[1:])
        return (max(own.get(g, 0) - discount, 0) + discount * len(own) * p(g[1:])) / total

    return math.log(p(text))


def test_spellings_against_a_plain_version():
    rng = random.Random(1)
    words = ["".join(rng.choice("abc") for _ in range(rng.randrange(1, 7))) for _ in range(40)]
    keys, n = np.unique(toxicity.grams(words)[0], return_counts=True)
    both = np.stack([n, np.where(np.arange(len(n)) % 3 == 0, 2, 0)], 1)
    model = toxicity.KneserNey(keys, both)
    as_bytes = lambda k: int(k).to_bytes(7, "big")
    # every type counts for the shared orders, whichever class has it
    per_class = [{as_bytes(k): int(c) for k, c in zip(keys, both[:, y])} for y in (0, 1)]
    for word in ["abca", "cccccc", "bxb", "d"]:
        own = toxicity.grams([word])[0]
        got = model.logp(own)
        want = [[plain_kneser_ney(c, as_bytes(k)) for c in per_class] for k in own]
        assert np.allclose(got, want)
        sums, sizes = model.evidence([word])
        assert sizes[0] == len(own) == len(word) + 1 and sums[0] == pytest.approx(np.diff(want, axis=1).sum())


def test_pairs_and_documents_against_a_plain_version(spark):
    rng = random.Random(6)
    texts = [(" ".join(rng.choice("abcdefg") * 3 for _ in range(12)), int(i % 3 == 0)) for i in range(30)]
    found = toxicity.pair_evidence(spark.createDataFrame(texts, "text string, __y int")).collect()
    count = {0: Counter(), 1: Counter()}
    for t, y in texts:
        w = t.split()
        count[y].update(set(zip(w, w[1:])))
    both = count[0] + count[1]
    share = {b: len({x for x in both if x[1] == b}) / len(both) for b in {x[1] for x in both}}

    def p(table, pair, lower):
        own = {x: n for x, n in table.items() if x[0] == pair[0]}
        return (max(own.get(pair, 0) - 0.75, 0) + 0.75 * len(own) * lower) / sum(own.values()) if own else lower

    key = lambda a, b: int(toxicity.pairs_of(np.array([toxicity.name(a), toxicity.name(b)], np.uint64))[0])
    want = {}
    for pair in count[1]:
        pooled = p(both, pair, share[pair[1]])
        want[key(*pair)] = math.log(p(count[1], pair, pooled)) - math.log(p(count[0], pair, pooled))
    pair = lambda r: int(toxicity.pairs_of(np.array([r["first"], r.second], np.int64).view(np.uint64))[0])
    assert {pair(r): pytest.approx(r.evidence) for r in found} == want

    keys, n = np.unique(toxicity.grams(["aaa", "bbb", "ccc", "ddd"])[0], return_counts=True)
    scorer = toxicity.Scorer(toxicity.KneserNey(keys, np.stack([n, n + (keys % 3 > 0)], 1)), toxicity.Pairs(np.array(list(want)), np.array(list(want.values()))))
    text = "Aaa bbb aaa, bbb zzz. ccc"
    w = text.lower().replace(",", "").replace(".", "").split()
    sums, sizes = scorer.model.evidence(w)
    evidence = [want[key(*x)] for x in zip(w, w[1:]) if key(*x) in want]
    got = scorer.features([None, text, ""])
    assert got[1][toxicity.TOP] == pytest.approx((sums.sum() + sum(evidence)) / sizes.sum()) and not got[[0, 2]].any()
    assert got[1][: toxicity.TOP].tolist() == pytest.approx(sorted((max(x, 0) for x in {k: v for k, v in zip(w, sums / sizes)}.values()), reverse=True)[: toxicity.TOP])


def test_toxicity_never_reads_labels_of_held_out_rows(docs, labels):
    flipped = labels.withColumn("toxic", F.when(common.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (toxicity.train(docs, x) for x in (labels, flipped))
    assert np.allclose(a[2], b[2])


def test_toxicity_of_odd_rows(spark, docs, labels):
    fitted = toxicity.train(docs, labels.unionByName(labels.limit(5).withColumn("toxic", F.lit(None).cast("int"))))
    odd = spark.createDataFrame([(None, None, 1), (1, "", 1), (1, "", 1), (2, "...", 1), (3, "w" * 100_000, 1)], "doc_id long, text string, score int")
    got = toxicity.score(odd, fitted).collect()
    assert len(got) == 5 and len({r.score for r in got if r.doc_id in (None, 1, 2)}) == 1
    assert toxicity.score(odd.limit(0), fitted).collect() == []
    assert toxicity.train(docs, labels.where("toxic = 0")) is None
    assert {r.score for r in toxicity.score(odd, None).collect()} == {0.0}


def test_kneser_ney_is_a_distribution():
    words = ["alpha", "beta", "gamma", "alpaca"] * 4
    keys, n = np.unique(toxicity.grams(words)[0], return_counts=True)
    model = toxicity.KneserNey(keys, np.stack([n, (n + 1) // 2], 1))
    context = keys[5] >> 8
    both = model.logp((context << 8) | np.arange(256))
    assert np.exp(both).sum(axis=0) == pytest.approx([1, 1])


def test_quality_on_rows_without_their_labels(docs, labels):
    hide = common.held_out(F.col("doc_id"))
    fitted = cotrain.train(docs, labels.where(~hide))
    got = cotrain.score(docs, fitted).join(labels.where(hide), "doc_id").toPandas()
    assert len(got) > 50 and (got.kept == (got.quality == 1)).mean() > 0.97
    kept = cotrain.keep_good(docs, fitted)
    assert kept.columns == docs.columns and kept.count() == cotrain.score(docs, fitted).where("kept").count()


def test_quality_of_odd_rows(spark, docs, labels):
    fitted = cotrain.train(docs, labels)
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", "", "", -5), (1, "", "", "", -5), (2, "a b " * 40_000, "s", "en", 1)], "doc_id long, text string, source string, lang string, n_chars long")
    assert len(cotrain.score(odd, fitted).collect()) == 4
    bare = odd.select("doc_id", "text").withColumn("score", F.lit(1))
    assert len(cotrain.score(bare, fitted).collect()) == 4
    assert cotrain.score(odd.limit(0), fitted).collect() == []
    assert cotrain.train(docs, labels.where("quality = 1")) is None
    assert cotrain.score(odd, None).where("NOT kept").count() == 0 and cotrain.keep_good(odd, None).count() == 4


def test_views_teach_each_other():
    """A content view that can't tell and a metadata view that can: pseudo-labels carry over, and the weights follow."""
    rng = np.random.default_rng(0)
    y = rng.integers(0, 2, 600)
    part = np.repeat([0, 1, 2], 200)
    meta = np.stack([y + rng.normal(0, 0.1, 600), rng.normal(size=600)], 1)
    a, b, w = cotrain.cotrain(rng.normal(size=(600, 3)), meta, y, part)
    p = a.odds(a.x) * w[0] + b.odds(b.x) * w[1] + w[2]
    assert ((p > 0) == (y == 1)).mean() > 0.97 and w[1] > 0.3


def plain_content(text):
    """The measures of a text by plain counting."""
    w = (text or "").encode().split()
    if not w:
        return [0.0] * 16
    n, raw = len(w), (text or "").encode()
    again = lambda x: len(x) - len(set(x))
    letters = sum(len(x) for x in w)
    of = lambda keep: sum(keep(chr(c)) for c in raw)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    upper, lower = of(lambda c: "A" <= c <= "Z"), of(lambda c: "a" <= c <= "z")
    symbol = lambda c: "!" <= c <= "~" and not c.isalnum() and c not in ".,;:!?'\"()-"
    return [
        1.0, min(1.0, math.log1p(n) / 10), again(w) / (n + 10), again(list(zip(w, w[1:]))) / (n + 10), again(list(zip(w, w[1:], w[2:]))) / (n + 10),
        sum(a == b for a, b in zip(w, w[1:])) / (n + 10), (max(Counter(w).values()) - 1) / (n + 10), min(2.0, letters / n / 10),
        of(symbol) / letters, of(lambda c: c in "!?") / letters, of(lambda c: "0" <= c <= "9") / letters, of(lambda c: c in ".,;:") / n,
        upper / max(1, upper + lower), 1 - len(set(lines)) / max(1, len(lines)), min(1.0, len(lines) / n), sum(len(x) <= 3 for x in w) / n,
    ]


def plain_logistic(x, y, penalty):
    """By gradient steps, each as long as the loss falls."""
    rows = np.hstack([np.array(x, float), np.ones((len(x), 1))])
    ridge = np.array([penalty] * (rows.shape[1] - 1) + [1e-9])
    loss = lambda w: np.logaddexp(0, -(2 * y - 1) * (rows @ w)).sum() + (ridge * w * w).sum() / 2
    w = np.zeros(rows.shape[1])
    for _ in range(200):
        p = 1 / (1 + np.exp(-rows @ w))
        step = np.linalg.lstsq((rows * (p * (1 - p))[:, None]).T @ rows + np.diag(ridge + 1e-9), rows.T @ (p - y) + ridge * w, rcond=None)[0]
        t = 1.0
        while loss(w - t * step) > loss(w) and t > 1e-6:
            t /= 2
        w = w - t * step
    return w


def plain_cotrain(x, m, y, part, rounds, sure, most):
    views = [np.array(x, float), np.array(m, float)]
    own = [{i: int(y[i]) for i in range(len(y)) if part[i] == 0} for _ in views]
    cal = [i for i in range(len(y)) if part[i] == 1]
    odds = lambda v, w, c: [max(-12.0, min(12.0, c[0] * float(np.clip(r @ w[:-1] + w[-1], -30, 30)) + c[1])) for r in views[v]]
    for r in range(rounds + 1):
        said = []
        for v in (0, 1):
            w = plain_logistic([views[v][i] for i in own[v]], np.array(list(own[v].values()), float), 0.1)
            c = plain_logistic([[float(np.clip(views[v][i] @ w[:-1] + w[-1], -30, 30))] for i in cal], y[cal].astype(float), 0.1)
            said.append(odds(v, w, c))
        if r < rounds:
            for v in (0, 1):
                p = {i: 1 / (1 + math.exp(-said[v][i])) for i in range(len(y)) if part[i] == 2}
                for label in (1, 0):
                    best = sorted(p, key=lambda i: (-(p[i] if label else 1 - p[i]), i))[: most * (r + 1)]
                    new = [i for i in best if (p[i] if label else 1 - p[i]) >= sure and i not in own[1 - v]][:most]
                    own[1 - v].update({i: label for i in new})
    w = plain_logistic([[said[0][i], said[1][i]] for i in cal], y[cal].astype(float), 0.1)
    return [max(w[0], 0) * a + max(w[1], 0) * b + w[2] for a, b in zip(*said)]


def test_content_against_plain_counting(docs):
    texts = [r.text for r in docs.limit(150).collect()] + [None, "", " \n", "a", "A a? #1\nA a? #1\n\n12,5", "é ü x" * 50]
    for t in texts:
        assert cotrain.content(t) == pytest.approx(plain_content(t))


def test_cotraining_against_a_plain_version(monkeypatch):
    """The same combined log-odds for every row, labelled, calibrating or pool, with ties among the pool rows."""
    monkeypatch.setattr(cotrain, "PER_ROUND", 7)
    rng = np.random.default_rng(3)
    y = rng.integers(0, 2, 160)
    part = np.repeat([0, 1, 2, 2], 40)
    x = np.round(np.stack([y + rng.normal(0, 0.6, 160), rng.normal(size=160)], 1), 1)
    m = np.round(np.stack([y + rng.normal(0, 0.5, 160), rng.normal(size=160)], 1), 1)
    x[-20:], m[-20:] = x[-40:-20], m[-40:-20]
    a, b, w = cotrain.cotrain(x, m, y, part, rounds=3)
    got = a.odds(a.x) * w[0] + b.odds(b.x) * w[1] + w[2]
    assert got == pytest.approx(plain_cotrain(x, m, y, part, 3, cotrain.SURE, 7), abs=1e-4)


def test_bounds_of_samples_hold(spark, docs, labels):
    """One id may fill a table: the draw is by row, so the bound holds; and the pool has no labelled row."""
    hot = spark.range(30_000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("w x y").alias("text"))
    assert 700 < common.bounded_sample(hot, 1000).count() < 1300
    repeated = docs.unionByName(docs).unionByName(docs)
    a, b = cotrain.train(docs, labels), cotrain.train(repeated, labels.limit(3).unionByName(labels), labelled=300)
    assert a is not None and b is not None
    everyone = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    assert cotrain.train(docs, everyone) is not None  # nothing is left for the pool
