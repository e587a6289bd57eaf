"""The ten operators against libraries, brute force and round trips."""

import collections
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quadrille.llm import common, html_text, jpeg_media, language_id, licences, mixing, near_dup, quality, sentencepiece_codec, token_counts, warc

ODD = [None, "", " ", "a", "a\n\nb  c", "x" * 5000, " " * 700 + "y", "é日本語😀 ΣİŒ", "<|endoftext|> hi <|STARTOFTEXT|>", "the " * 3000, "a▁b"]
SCHEMA = "doc_id long, text string, source string, lang string"


def fuzz(n=300, seed=1):
    rng = random.Random(seed)
    letters = "ab  \n\tthes'é日本ΣİŒ0123²\x1c\x85 😀<|>_!."
    return ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(n)]


def docs(spark, texts=ODD, **extra):
    rows = [(k, t, f"s{k % 3}" if k % 4 else None, "en" if k % 2 else None) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def test_codec_equals_library(monkeypatch):
    import sentencepiece

    path = public_tokenizers.path(sentencepiece_codec.MODEL)
    ours, theirs = sentencepiece_codec.Codec(path), sentencepiece.SentencePieceProcessor(model_file=path)
    rng = random.Random(8)
    runs = [pre + " " * n + w for n in (1, 2, 3, 15, 16, 17, 31, 32, 33, 47, 48, 49, 50, 130) for w in ("", "a", "日", "\n") for pre in ("", "q")]
    joined = ["".join(rng.choice("etaoinshr") for _ in range(rng.randint(60, 900))) for _ in range(40)]
    for t in [x or "" for x in ODD] + fuzz() + runs + joined:
        assert ours.encode(t) == theirs.encode(t)
        assert ours.decode(ours.encode(t)) == t.replace("▁", " ")
    monkeypatch.setattr(sentencepiece_codec, "CHUNK", 40)
    for t in ["".join(fuzz(30, k)) for k in range(30)] + runs:
        assert ours.encode(t) == theirs.encode(t)


def test_stream_commits_before_the_end():
    """Tokens of a long segment come out while its end is unread, so what is kept is bounded by where paths meet, not by the text."""
    bpe = sentencepiece_codec.Codec(public_tokenizers.path(sentencepiece_codec.MODEL)).bpe
    kept = []
    agreed = bpe._agreed
    bpe._agreed = lambda last: (kept.append(len(last)), agreed(last))[1]
    text = "internationalizationofeverything" * 400
    parts = list(bpe.stream(text))
    assert "".join(t for p in parts for t in p) == text and [t for p in parts for t in p] == bpe.merge(text)
    assert len(kept) > 100 and max(kept) <= 8 * bpe.longest
    bpe._agreed = lambda last: len(last) - 1  # a window that commits too early gives other tokens
    assert [t for p in bpe.stream(text) for t in p] != bpe.merge(text)


def test_neighbour_rule_equals_merging():
    bpe = sentencepiece_codec.Codec(public_tokenizers.path(sentencepiece_codec.MODEL)).bpe
    rng = random.Random(3)
    tokens = sorted(t for t in bpe.tokens if t.isalpha() and t.isascii())
    for _ in range(1500):
        a, b = rng.choice(tokens), rng.choice(tokens)
        assert bpe.neighbours((a, b)) == (bpe.merge(a + b) == [a, b])


def test_token_counts_equal_library(spark):
    import tokenizers

    path = public_tokenizers.path(token_counts.MODEL)
    ours, theirs = token_counts.WordBpe(path), tokenizers.Tokenizer.from_file(path)

    def count(t):
        return len(theirs.encode(t, add_special_tokens=False).ids)

    def prefixes(texts):
        counts, ends = ours.prefixes(texts)
        return [counts[a:b].tolist() for a, b in zip([0, *ends[:-1]], ends)]

    texts = [x or "" for x in ODD] + fuzz() + ["don't we'll 'tis a'b", "internationalization", "x<|endoftext|>y"]
    for t, p in zip(texts, prefixes(texts)):
        assert p[-1] == count(t)
    short = [t for t in texts if len(t) < 60 and "STARTOF" not in t]
    for t, p in zip(short, prefixes(short)):
        norm = ours.normal(t)
        assert p == [count(norm[:k]) for k in range(len(norm) + 1)]
    rows = token_counts.token_counts(docs(spark, [*texts, "x" * 9000]), stored=True, limit=5)
    for r in rows.where("text is null or text not like '%STARTOF%'").withColumn("at", token_counts.within(F.col("tokens")["counts"], 5)).collect():
        want = max(k for k, n in enumerate(r.tokens.counts) if n <= 5)
        assert r.tokens.n_tokens == r.tokens.counts[-1] and r.tokens.chars_in_limit == r.at == want and ours.prefixes([ours.normal(r.text or "")[:want]])[0][-1] <= 5


def test_media_round_trip(spark):
    rows = jpeg_media.features(jpeg_media.store(docs(spark))).collect()
    for r in rows:
        want = jpeg_media.pad((r.text or "").encode())
        assert r.features.payload_sha256 == hashlib.sha256(want).hexdigest() and r.features.tail_crc32 == zlib.crc32(want[-64:])
    raw = np.random.default_rng(0).integers(0, 256, 64 * 9000, np.uint8).tobytes()  # full bytes and more than one row of blocks
    (head, coef), = jpeg_media.decode_images([jpeg_media.encode_payload(raw)])
    assert jpeg_media.payload_of(head, coef) == raw and jpeg_media.thumbnail(head, coef).shape == (2, 8191)


def test_warc_pushdown_and_round_trip(spark, tmp_path):
    big = "<p>" + "x" * 200
    pages = spark.createDataFrame([(3, "http://a/\r\nb", big), (1, None, big), (2, "u", "small"), (4, "u", "small"), (5, "u", None)], "page_id long, url string, html string")
    path = f"file://{tmp_path}/w"
    warc.write_warc(pages, path)
    got = {(r.record_id, r.record_type, r.refers_to, r.payload_length) for r in warc.read_warc(spark, path).collect()}
    assert got == {("<urn:page:3>", "revisit", "<urn:page:1>", 203), ("<urn:page:1>", "response", None, 203), ("<urn:page:2>", "response", None, 5), ("<urn:page:4>", "response", None, 5), ("<urn:page:5>", "response", None, 0)}
    full = warc.read_warc(spark, path, "full").where("record_type = 'response' and record_id = '<urn:page:1>'")
    assert bytes(full.first().payload) == big.encode()


@pytest.mark.parametrize("bits", [1 << 26, 64])
def test_warc_revisits(spark, tmp_path, bits):
    """Groups of copies, ids that repeat, null ids; with few bits most responses share one with a revisit."""
    rng = random.Random(3)
    rows = [(k, "u", rng.choice(["p", "q", "r", "s"]) * 150 if k % 3 else f"{k} " * 60) for k in range(200)] + [(7, "u", "p" * 150), (7, "u", "other " * 40), (None, "u", "q" * 150), (None, None, None), (9, "u", "7 "), (10, "u", "7 ")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    path = f"file://{tmp_path}/w{bits}"
    warc.write_warc(df, path, bits=bits)
    first = {}
    for i, _, h in rows:
        if i is not None and h and len(h) >= 100:
            first[h] = min(first.get(h, i), i)
    want = sorted((f"<urn:page:{i}>" if i is not None else "", "response" if h not in first or i == first[h] else "revisit", "" if h not in first or i == first[h] else f"<urn:page:{first[h]}>", hashlib.sha256((h or "").encode()).hexdigest(), len(h or "")) for i, _, h in rows)
    got = sorted((r.record_id or "", r.record_type, r.refers_to or "", r.payload_digest[7:], r.payload_length) for r in warc.read_warc(spark, path).collect())
    assert got == want
    warc.write_warc(df.limit(0), path + "-empty")
    assert warc.read_warc(spark, path + "-empty").count() == 0


def test_html_text():
    page = '<html><head><title>t</title></head><body><nav><a href="/">Home</a></nav><div class="ad">Buy</div><article><h1>A &amp; B</h1><p>one <b>two</b>\n three<br>four<p>five<div class="comments">no</div><form>x</form></article><aside>side</aside><footer>f</footer></body></html>'
    e = html_text.Extractor(html_text.weights_from([page]))
    assert e.extract(page) == "A & B\none two three four\nfive"
    assert e.extract(None) == "" and e.extract("<p></p>") == "" and e.extract("<nav>menu") == ""
    assert e.extract("<div><p>just text here</p></div><footer>f</footer>") == "just text here"


def test_html_region_equals_brute_force():
    """The scan finds a run of the highest sum of all runs, on random tokens and weights."""
    rng = random.Random(6)
    for _ in range(60):
        kinds = ["word", "link", "p", "/p", "div", "?nav", "a"]
        e = html_text.Extractor({k: rng.uniform(-2, 2) for k in kinds})
        toks = [(k, rng.randint(1, 9), 0, "t" if k in ("word", "link") else None) for k in rng.choices(kinds, k=rng.randint(1, 30))]
        s = e.scores(toks)
        a, b = e.region(toks)
        assert abs(sum(s[a:b]) - max([0.0, *(sum(s[i:j]) for i in range(len(s)) for j in range(i + 1, len(s) + 1))])) < 1e-9


def test_html_weights_decide():
    """Other weights give another text: of suspect elements inside the region, and of what belongs to it at all."""
    page = "<body><ul><li><a>one</a></li><li><a>two</a></li></ul><div><p>" + "main " * 9 + "</p><div class='ad'>buy</div><p>" + "more " * 9 + "</p></div><p>x</p><ul><li><a>three</a></li></ul></body>"
    labelled = "<body><nav>m</nav><ul><li><a>l</a></li></ul><article><p>" + "red " * 40 + "</p><div class='ad'>b</div></article><ul><li><a>k</a></li></ul></body>"
    w = html_text.weights_from([labelled] * 20)
    main, more = "main " * 8 + "main", "more " * 8 + "more"
    assert html_text.Extractor(w).extract(page) in (f"{main}\n{more}", f"{main}\n{more}\nx")
    assert "one" in html_text.Extractor(w | {"link": 50.0}).extract(page)
    assert "buy" in html_text.Extractor(w | {"?ad": 0.5}).extract(page)
    assert html_text.Extractor(w | {"?ad": -50.0}).extract(page) in (main, more, more + "\nx")
    assert w["word"] > 0 and w["?ad"] < -0.5


def test_html_keeps_all_articles_and_text_beside_them():
    page = "<html><head></head><body><nav>menu</nav><article><h1>A</h1><p>one two</p></article><footer>f</footer></body></html>"
    e = html_text.Extractor(html_text.weights_from([page]))
    split = f"<body><nav>menu</nav><article><p>{'red ' * 20}</p></article><div class='ad'>buy</div><article><p>{'blue ' * 30}</p></article><footer>f</footer></body>"
    assert e.extract(split) == "red " * 19 + "red\n" + "blue " * 29 + "blue"
    card = f"<body><nav>menu</nav><div><p>{'main ' * 60}</p><article><p>a card</p></article><p>{'more ' * 60}</p></div><footer>f</footer></body>"
    assert e.extract(card) == "main " * 59 + "main\na card\n" + "more " * 59 + "more"
    # An article that the region only reaches into is still taken whole.
    long = f"<body><article><p>start</p><ul>{'<li><a>x</a></li>' * 60}</ul><p>{'text ' * 40}</p></article></body>"
    assert e.extract(long).startswith("start\nx\n") and e.extract(long).endswith("text")


def test_html_labelled_pages_are_drawn_from_marked_ones(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(html_text, "weights_from", lambda pages: seen.append(len(pages)))
    pages = spark.range(20_000).select(F.col("id").alias("page_id"), F.when(F.col("id") % 80 == 0, "<article>a</article>").otherwise("<p>a</p>").alias("html"))
    html_text.fit(pages)  # 250 of 20,000 pages are marked
    html_text.fit(pages.where("page_id % 1600 = 0"))
    html_text.fit(pages.withColumn("page_id", F.lit(1)))
    assert seen == [200, 13, 200]


def test_licences(spark):
    got = licences.scan(docs(spark, [*ODD, "x\nReleased under the MIT License.", "Licensed under CC BY-NC 4.0.\nReleased under the MIT License.", "the copyright debate went on"]))
    rows = {r.doc_id: [(f.paragraph, f.family, f.confirmed) for f in r.findings] for r in got.collect()}
    n = len(ODD)
    assert rows[n] == [(1, "MIT", True)] and rows[n + 1] == [(0, "CC-BY-NC", True), (1, "MIT", True)] and not any(c for _, _, c in rows[n + 2])
    fit = licences.model()
    for texts in licences.TEMPLATES.values():
        for t in texts:
            p = fit.probabilities(t)
            (f,) = spark.range(1).select(licences._finding(F.lit(t), fit).alias("f")).first()
            assert f.family in (fit.labels[int(p.argmax())], licences.UNKNOWN) and abs(f.score - p.max()) < 1e-9


def test_licences_without_stem(spark):
    want = {"All rights reserved.": "Proprietary", "\u00a9 2020 Example. All rights reserved.": "Proprietary", "AGPL v3": "AGPL", "LGPL": "LGPL", "(GPL v2)": "GPL", "GPLv3": "GPL", "GPL": "GPL", "Apache 2.0": "Apache", "MIT": "MIT", "this software and associated documentation files (the \"Software\"), to deal in the Software without restriction": "MIT"}
    none = ["mit", "Version 2.0", "or later", "this project", "Er kam mit der Bahn.", "ER KAM MIT DER BAHN", "the end of the road to the sea", "in the"]
    got = {r.text: r.findings for r in licences.scan(docs(spark, [*want, *none])).collect()}
    assert {t: [(f.family, f.confirmed) for f in got[t]] for t in want} == {t: [(f, True)] for t, f in want.items()}
    assert not any(got[t] for t in none)
    (f,) = licences.scan(docs(spark, ["GPL software of some sort"])).first().findings
    assert f.paragraph == 0 and licences.scan(docs(spark, ["red\nLGPL"])).first().findings[0].paragraph == 1


def test_forward_backward_equals_enumeration():
    import itertools

    rng = np.random.default_rng(2)
    emit, jump, start, lengths = rng.normal(size=(7, 3)), rng.normal(size=(3, 3)), rng.normal(size=3), np.array([4, 1, 2])
    got, _ = language_id.forward_backward(emit, lengths, jump, start)
    at = 0
    for n in lengths:
        total = np.zeros((n, 3))
        for ys in itertools.product(range(3), repeat=int(n)):
            w = np.exp(start[ys[0]] + sum(emit[at + k, y] for k, y in enumerate(ys)) + sum(jump[a, b] for a, b in zip(ys, ys[1:])))
            for k, y in enumerate(ys):
                total[k, y] += w
        assert np.allclose(got[at : at + n], total / total.sum(1, keepdims=True))
        at += n


def test_language(spark):
    rows = [(k, t * 3, None, lang) for k, (t, lang) in enumerate([("the cat and the dog. ", "en"), ("der hund und die katze. ", "de")] * 20)]
    df = spark.createDataFrame(rows, SCHEMA)
    crf = language_id.fit(df)
    got = {r.text: r.language for r in language_id.identify(docs(spark, [None, "", "12 !", "the dog", "die katze"]), crf).collect()}
    assert [got[t].lang_pred for t in (None, "", "12 !", "the dog", "die katze")] == ["und", "und", "und", "en", "de"]
    assert language_id.identify(docs(spark), language_id.fit(df.limit(0))).where("language.lang_pred <> 'und'").isEmpty()


def test_language_of_long_words_and_numerals(spark):
    assert language_id.WORDS("½ ² Ⅷ 12") == [] and language_id.WORDS("a½b c") == ["a", "b", "c"]
    long = "x" * 24 + "straßenbahn"
    assert "".join(language_id.WORDS(long)) == long and max(map(len, language_id.WORDS(long))) <= language_id.LONGEST
    # Two words that differ only far behind are told apart.
    rows = [(k, f"{'q' * 24}{tail * 3} " * 8, None, lang) for k, (tail, lang) in enumerate([("thingly", "en"), ("heitung", "de")] * 20)]
    crf = language_id.fit(spark.createDataFrame(rows, SCHEMA))
    got = {r.text: r.language for r in language_id.identify(docs(spark, ["½ ²", "q" * 24 + "thingly" * 3, "q" * 24 + "heitung" * 3, "Ⅷ"]), crf).collect()}
    assert (got["½ ²"].lang_pred, got["½ ²"].score, got["Ⅷ"].lang_pred) == ("und", 0.0, "und")
    assert [r.lang_pred for t, r in sorted(got.items()) if t[0] == "q"] == ["de", "en"]
    # A language that only long rows have is learned.
    long = spark.createDataFrame([(k, t * 2000, None, lang) for k, (t, lang) in enumerate([("the cat sat. ", "en"), ("der hund lief. ", "de")] * 20)], SCHEMA)
    got = {r.text: r.language.lang_pred for r in language_id.identify(docs(spark, ["the cat", "der hund"]), language_id.fit(long)).collect()}
    assert got == {"the cat": "en", "der hund": "de"}


def test_language_of_many_words_takes_them_in_parts(monkeypatch):
    """However many words a batch has, so many are worked on at a time; the answers stay."""
    crf = language_id.train([("The cat sat on the mat. A dog barks. ", "en"), ("Der Hund bellt. Die Katze schläft. ", "de")] * 20)
    texts = ["The dog sat. Der Hund bellt laut.\n" * 40, None, "", "Die Katze. " * 90, "42", "A cat " * 60]
    want = language_id.Labeller(crf).label(texts)
    seen = []
    one = language_id.forward_backward
    monkeypatch.setattr(language_id, "forward_backward", lambda emit, *a: (seen.append(len(emit)), one(emit, *a))[1])
    monkeypatch.setattr(language_id, "WORDS_AT_ONCE", 50)
    got = language_id.Labeller(crf, words=8).label(texts)
    assert [g[0] for g in got] == [w[0] for w in want] == ["de", "und", "und", "de", "und", "en"]
    assert np.allclose([g[1] for g in got], [w[1] for w in want]) and len(seen) > 5 and max(seen[:-1]) < 60 and seen[-1] < 50 + 120  # a sentence is whole


def test_workers_drop_what_another_operator_kept(spark):
    """A worker that has encoded doesn't hold the codec while the next operator runs in it."""
    wide = docs(spark, fuzz(64)).repartition(8)
    assert sentencepiece_codec.encode(wide).where("size(ids) > 0").count()

    def make():
        held = sentencepiece_codec.codec_of.cache_info().currsize
        return lambda texts: [[held] * len(texts)]

    held = common.struct_udf(make, [("held", pa.int64())])
    assert wide.select(held("text")["held"].alias("held")).agg(F.max("held")).first()[0] == 0


def test_forest_paths_equal_recursion():
    rng = np.random.default_rng(4)
    rows = rng.normal(size=(60, 4))
    for margin in (0.0, 1.0):
        forest = quality.Forest(rows, trees=7, margin=margin)

        def path(row, tree, k=0):
            feature, cut, left, right, lengths = tree
            return lengths[k] if feature[k] < 0 else path(row, tree, left[k] if row[feature[k]] <= cut[k] else right[k])

        tested = rng.normal(scale=3, size=(40, 4))
        want = [2 ** (-sum(path(r, t) for t in forest.trees) / 7 / forest.expected(60)) for r in tested]
        assert np.allclose(forest.score(tested), want)


def brute_statistics(text):
    words = quality.WORDS(text or "")
    windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    inside = {k + j for k, w in enumerate(windows) if windows.count(w) > 1 for j in range(3)}
    lines = [x for x in (text or "").split("\n") if quality.WORDS(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), sum(x in lines[:k] for k, x in enumerate(lines)), len(inside)


@pytest.mark.parametrize("text", [*[t for t in ODD if t != "the " * 3000], "a b c a b c", "a a a a", "x\nx\n\n \nx # |", "a b c d a b c e a b"])
def test_quality_statistics(text):
    assert quality.statistics(text)[:5] == brute_statistics(text)


def test_quality_divides(spark):
    rng = random.Random(5)
    good = [" ".join(rng.choice(["red", "green", "blue", "tree", "stone", "river"]) + str(rng.randint(0, 99)) for _ in range(90)) for _ in range(40)]
    bad = [g.replace(" ", "*** ") for g in good]
    df = docs(spark, good + bad)
    labels = spark.createDataFrame([(k, int(k < 40)) for k in range(80)], "doc_id long, quality int")
    got = quality.judge(df, quality.fit(df, labels)).select("doc_id", "quality.kept").collect()
    assert all(r.kept == (r.doc_id < 40) for r in got)
    assert quality.judge(docs(spark), quality.fit(docs(spark).limit(0), labels)).count() == len(ODD)


def test_quality_of_ratios_without_bad_labels(spark):
    """The bad rows show symbols alone; documents odd in any other ratio go too."""
    rng = random.Random(6)

    def plain(n=120):
        return [rng.choice(["red", "green", "blue", "tree", "stone", "river"]) + str(rng.randint(0, 99)) for _ in range(n)]

    def lines(words):
        return "\n".join(" ".join(words[k : k + 10]) for k in range(0, len(words), 10))

    good = [lines(plain()) for _ in range(60)]
    bad = [g.replace(" ", "*** ") for g in good[:20]]
    odd = [lines(plain()).upper(), lines(plain()).replace(" ", "!! "), lines([w * 8 for w in plain()]), lines(plain()) + "\nbuy now" * 25]
    labels = spark.createDataFrame([(k, int(k < 60)) for k in range(80)], "doc_id long, quality int")
    model = quality.fit(docs(spark, good + bad), labels)
    got = {r.doc_id: r.quality for r in quality.judge(docs(spark, good + bad + odd), model).collect()}
    assert [got[k].kept for k in range(80)] == [True] * 60 + [False] * 20
    assert not any(got[k].base_failed or got[k].kept for k in range(80, 83)) and not got[83].kept


def test_probminhash_estimates_jaccard():
    rng = np.random.default_rng(1)
    h = near_dup.mix(rng.integers(0, 1 << 62, 400).astype(np.uint64))
    a, b = h[:300], h[60:]
    doc = np.repeat([0, 1], [len(a), len(b)])
    s = near_dup.sketch(np.concatenate([a, b]), doc, np.ones(len(doc)), 2, 2048)
    assert abs((s[0] == s[1]).mean() - 240 / 400) < 0.05


def test_near_dup_equals_brute_force(spark):
    rng = random.Random(9)
    base = [[f"w{rng.randint(0, 500)}" for _ in range(100)] for _ in range(12)]
    texts = list(ODD)
    for words in base:
        for _ in range(6):
            copy = list(words)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(100)] = f"v{rng.randint(0, 9)}"
            texts.append(" ".join(copy))
    texts += texts[-3:]
    sets = {}
    for k, t in enumerate(texts):
        w = near_dup.WORDS(t or "")
        sets[k] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())
    parent = list(range(len(texts)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in range(a):
            if sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                parent[max(top(a), top(b))] = min(top(a), top(b))
    got = {r.doc_id: r.class_id for r in near_dup.classes(docs(spark, texts)).collect()}
    assert got == {k: top(k) for k in sets}
    assert near_dup.classes(docs(spark).limit(0)).count() == 0


def test_near_dup_versions_of_variants(spark, monkeypatch):
    """Variants of a text that differ too much from it, in versions that differ little: only those that share more than the text are compared."""
    rng = random.Random(12)
    base = [f"w{k}" for k in range(200)]
    texts = [" ".join(base)]
    for f in range(30):
        words = list(base)
        for k in rng.sample(range(5, 190, 7), 5):
            words[k] = f"f{f}x{k}"
        for v in range(12):
            copy = list(words)
            copy[rng.randrange(200)] = f"v{rng.randint(0, 30)}"
            texts.append(" ".join(copy[: rng.choice([200, 200, 185, 170])]))
    for _ in range(40):  # cuts of the text, at both ends: some share nothing that it lacks
        texts.append(" ".join(base[rng.randint(0, 30) : rng.randint(160, 200)] + [f"z{rng.randint(0, 9)}"] * rng.randint(0, 1)))
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(near_dup.WORDS, texts)]
    top = list(range(len(texts)))
    for _ in range(3):
        for a in range(len(sets)):
            for b in range(a):
                if top[a] != top[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                    top = [min(top[a], top[b]) if t in (top[a], top[b]) else t for t in top]
    tried = []
    compared = near_dup.compared
    monkeypatch.setattr(near_dup, "compared", lambda pairs, *rest: (tried.append(pairs.count()), compared(pairs, *rest))[1])
    got = {r.doc_id: r.class_id for r in near_dup.classes(docs(spark, texts)).collect()}
    assert got == dict(enumerate(top)) and len(set(top)) > 10
    assert sum(tried) < 20_000  # of 80,000 pairs


def test_components(spark):
    rng = random.Random(4)
    links = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(45)]
    parent = {x: x for ab in links for x in ab}
    for _ in range(60):
        for a, b in links:
            parent[a] = parent[b] = min(parent[a], parent[b])
    got = {r.node: r["class"] for r in near_dup.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: c for x, c in parent.items() if x in got} and {x for a, b in links if a != b for x in (a, b)} == set(got)


def test_mixing(spark):
    rng = random.Random(2)
    texts = [" ".join(["w"] * rng.randint(0, 30)) or None for _ in range(600)]
    rows = [(k, t, rng.choice(["a", "b", "c", None]) if k > 20 else "tiny", "en") for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, SCHEMA)
    plan = mixing.plan_mix(df).collect()
    assert len(plan) == 600 and [tuple(r) for r in plan] == [tuple(r) for r in mixing.plan_mix(df).collect()]
    by = collections.defaultdict(list)
    for r in plan:
        by[r.source].append(r)
    assert abs(sum(rs[0].target for rs in by.values()) - sum(r.size for r in plan)) < 1e-6
    for rs in by.values():
        assert rs[0].target <= 3 * rs[0].source_size + 1e-9 and max(r.copies for r in rs) <= 3
        assert abs(sum(r.copies * r.size for r in rs) - rs[0].target) <= 30
    assert mixing.mix(df).count() == sum(r.copies for r in plan)
    assert mixing.plan_mix(df.limit(0)).count() == 0


def test_clashing_columns(spark):
    wide = docs(spark).withColumns({"copies": F.lit(1), "level": F.lit(2), "quality": F.lit(3), "language": F.lit(4), "size": F.lit(5)})
    assert mixing.mix(wide).columns == wide.columns


def test_empty_tables_and_clashing_names(spark):
    """No operator minds an empty table, repeated rows, or columns of any name; a column named as a result is replaced."""
    names = ["ids", "decoded", "media", "features", "tokens", "findings", "language", "quality", "level", "copy", "place", "size", "class_id", "kept_id", "s", "key", "bands", "marked", "bucket"]
    wide = docs(spark, [*ODD, *ODD[:3]]).withColumns({n: F.lit(1) for n in names})
    crf = language_id.train([("the cat. ", "en"), ("der hund. ", "de")])
    model = quality.Model(quality.Forest(np.ones((2, len(quality.RATIOS)))), 0.5)
    runs = [
        lambda d: sentencepiece_codec.decode(sentencepiece_codec.encode(d)),
        lambda d: jpeg_media.features(jpeg_media.store(d)),
        token_counts.token_counts,
        licences.scan,
        lambda d: language_id.identify(d, crf),
        lambda d: quality.judge(d, model),
        lambda d: html_text.extract(d, "text", "page", {"word": 1.0}),
        near_dup.classes,
        mixing.plan_mix,
    ]
    for run in runs:
        assert run(wide).count() == wide.count() and run(wide.limit(0)).count() == 0
    assert html_text.fit(spark.createDataFrame([], "page_id long, html string"))["word"] > 0


@pytest.fixture(scope="module")
def corpus(spark):
    return {r.doc_id: r for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}


def run_query(spark, name):
    import __spark_entry__

    return __spark_entry__.queries()[name](spark, "/root/testdata/sf0.001").collect()


def test_op1_query(spark, corpus):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(sentencepiece_codec.MODEL))
    got = run_query(spark, "op1_sentencepiece")
    assert len(got) == len(corpus) and all(list(r.ids) == sp.encode(corpus[r.doc_id].text or "") and r.n_tokens == len(r.ids) and r.round_trip for r in got)


def test_op3_query(spark, corpus):
    for r in run_query(spark, "op3_media"):
        raw = (corpus[r.doc_id].text or "").encode()
        want = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(want), hashlib.sha256(want).hexdigest(), zlib.crc32(want[-64:]))


def test_op4_query(spark, corpus):
    import tokenizers

    lib = tokenizers.Tokenizer.from_file(public_tokenizers.path(token_counts.MODEL))
    for r in run_query(spark, "op4_token_counts"):
        n = len(lib.encode(corpus[r.doc_id].text or "", add_special_tokens=False).ids)
        assert (r.n_tokens, r.over_limit) == (n, n > 2048) and (r.chars_in_limit > 0) == (n > 0)


def test_op7_op8_queries(spark, corpus):
    got = {r.doc_id: r for r in run_query(spark, "op7_language")}
    assert all(r.held_out == (zlib.crc32(str(k).encode()) % 4 == 2) for k, r in got.items())
    known = [k for k, r in got.items() if r.held_out and corpus[k].lang]
    assert sum(got[k].lang_pred == corpus[k].lang for k in known) >= 0.9 * len(known)
    for r in run_query(spark, "op8_quality"):
        s = brute_statistics(corpus[r.doc_id].text) if len(corpus[r.doc_id].text or "") < 3000 else (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == s and r.base_failed == (s[0] < 50 or 100 * s[4] > 50 * s[0]) and not (r.base_failed and r.kept)


def test_pipeline_equals_its_operators(spark, corpus):
    """The stages by plain Python over what each operator says of its own input."""
    import sentencepiece

    import corpus_pipeline

    where = "/root/testdata/sf0.001"
    all_docs = spark.read.parquet(f"{where}/documents.parquet")
    judged = {r.doc_id: r.quality.kept for r in quality.judge(all_docs, quality.fit(all_docs, spark.read.parquet(f"{where}/labels.parquet"))).collect()}
    kept = all_docs.where(F.col("doc_id").isin([k for k, v in judged.items() if v]))
    known = {r.doc_id: r.language for r in language_id.identify(kept, language_id.fit(all_docs)).collect()}
    kept = kept.where(F.col("doc_id").isin([k for k, v in known.items() if v.lang_pred != "und" and v.score >= language_id.MIN_SCORE]))
    kept = kept.where(F.col("doc_id").isin([r.doc_id for r in near_dup.classes(kept).collect() if r.doc_id == r.class_id]))
    copies = {r.doc_id: r.copies for r in mixing.plan_mix(kept).collect()}
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(sentencepiece_codec.MODEL))
    want = collections.Counter({(k, tuple(sp.encode(corpus[k].text))): n for k, n in copies.items() if n})
    got = collections.Counter((r.doc_id, tuple(r.ids)) for r in corpus_pipeline.run(spark, where).collect())
    assert got == want and len(corpus_pipeline.STAGES) == 5
