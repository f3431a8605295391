"""The text operators against plain versions, and the odd inputs: nulls, empty and long texts, ties, repeated rows, empty tables,
columns with clashing names."""

import collections
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from packetloom.llm import html_seed, html_tree, lang_id, packing, quality_mil, quality_rules, sentence_pieces, sharding, shingle_join, url_rules, vector_pairs
from packetloom.llm.common import connected_components

from ..conftest import DATA

ODD = [None, "", " \n\t ", "a", "x y\x1cz\x85w", "Éa " * 70, "<|endoftext|> it's 12 # $", "日本語 👍🏽 " * 30, "word " * 30000]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(100, "same " * 60), (101, "same " * 60), (101, "same " * 60), (None, "no id here at all")]
    return spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("size", "n_words", "bucket", "x", "component", "kept", "label", "piece")})


def empty(frame):
    return frame.where("false")


# 1. Vectors


def test_vectors_against_brute_force(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(40, 16))
    rows = [(i, (base[i % 40] + rng.normal(size=16) * 0.15).tolist(), i % 3) for i in range(200)]
    rows += [(900, None, 1), (901, [0.0] * 16, 1), (902, [float("nan")] * 16, 1), (903, [None] * 16, 1), (904, base[0].tolist(), None), (905, [float("inf")] + [1.0] * 15, 1)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vector_pairs.vector_links(frame, block=32).collect()}
    x = np.array([r[1] for r in rows[:200]])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = (x @ x.T >= 0.93) & (np.arange(200)[:, None] % 3 == np.arange(200) % 3)
    np.fill_diagonal(near, False)
    comp = np.arange(200)
    for _ in range(200):
        comp = np.minimum(comp, np.where(near, comp, 999).min(1))
    assert {i: (near[i].sum(), comp[i], comp[i] == i) for i in range(200)} == {i: got[i] for i in range(200)}
    assert all(got[i] == (0, i, True) for i in range(900, 906))
    assert near.sum() > 50
    assert vector_pairs.vector_links(empty(frame)).count() == 0


def test_links_of_repeated_ids(spark):
    """Two rows of one id that link with each other have one link each; equal vectors link too."""
    rows = [(1, [1.0, 0.0], 0), (1, [0.99, 0.05], 0), (2, [0.0, 1.0], 0), (2, [0.0, 1.0], 0), (7, [-1.0, 0.0], 0), (None, [1.0, 0.0], 0), (8, [], 0), (9, [1.0], 0), (10, [1e200, 1e-200], 1), (11, [1e-200, 0.0], 1), (12, [None, 1.0], 0), (13, [1.0, float("nan")], 0), (14, [float("-inf"), 1.0], 0)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("n", F.lit("clash")).withColumn("node", F.lit(1))
    got = collections.Counter(tuple(r) for r in vector_pairs.vector_links(frame).collect())
    assert got == collections.Counter([(1, 1, 1, True)] * 2 + [(2, 1, 2, True)] * 2 + [(7, 0, 7, True), (None, 0, None, True), (8, 0, 8, True), (9, 0, 9, True), (10, 1, 10, True), (11, 1, 10, False), (12, 0, 12, True), (13, 0, 13, True), (14, 0, 14, True)])


def test_a_hot_vector(spark):
    rows = [(i, [1.0, 2.0, 3.0], 0) for i in range(3000)] + [(9000 + i, [float(i), -1.0, 2.0], 0) for i in range(5)] + [(8000, [1.0, 2.0, 3.01], 0)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in vector_pairs.vector_links(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    assert all(got[i] == (3000, 0) for i in range(3000)) and got[8000] == (3000, 0) and len(got) == 3006


def test_estimate_is_unbiased():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(2000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    code, factor, rounded, step = vector_pairs.encode(x)
    assert code.shape == (2000, 8) and rounded.dtype == np.int8
    signs = np.where(np.unpackbits(code, axis=1) > 0, 1, -1) / 8
    error = (rounded[:1000] * step[:1000, None] * signs[1000:]).sum(1) / factor[1000:] - (x[:1000] * x[1000:]).sum(1)
    assert abs(error.mean()) < 0.01


def test_the_bound_drops_pairs_but_no_link():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 48))
    x[150:] = x[:150] + rng.normal(size=(150, 48)) * rng.uniform(0, 0.6, size=(150, 1))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    code, factor, rounded, step = vector_pairs.encode(x)
    left = {(int(a), int(b)) for i, j in vector_pairs.likely((rounded, step), (code, factor), 48, 0.93, True) for a, b in zip(i, j)}
    links = {(int(a), int(b)) for a, b in zip(*np.nonzero(np.triu(x @ x.T >= 0.93, 1)))}
    assert links <= left and len(links) > 30 and len(left) < 300 * 299 / 2 / 20


# 2. Languages


def test_language_accuracy(spark, docs):
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    model = lang_id.train(docs.where(~held))
    rows = lang_id.identify(docs.where(held), model).join(docs.select("doc_id", "lang"), "doc_id").where("accepted").collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.9 * len(rows)


def test_language_odd_rows(spark, odd, docs):
    model = lang_id.train(docs)
    got = lang_id.identify(odd, model).collect()
    assert len(got) == odd.count()
    by = {r.doc_id: r for r in got}
    assert by[0].lang_pred == by[1].lang_pred == by[2].lang_pred == "und" and by[0].score == 0
    assert all(0 <= r.score <= 1 for r in got)
    assert lang_id.language_filter(empty(odd), model).columns == odd.columns
    assert lang_id.train(docs.where("false")).dictionaries == {}
    assert lang_id.identify(odd, lang_id.Model({}, {})).where("lang_pred <> 'und'").count() == 0


def brute_language(model, text):
    """One compression a block and language, by the public interface alone."""
    import math

    import zstandard

    if not text or not any(c.isalpha() for c in text):
        return "und", False
    raw, sizes = text.lower().encode(), {}
    for lang, content in model.dictionaries.items():
        options = zstandard.ZstdCompressionParameters.from_level(3, dict_size=lang_id.DICTIONARY_BYTES, source_size=lang_id.BLOCK, strategy=zstandard.STRATEGY_GREEDY, min_match=4, search_log=3, write_checksum=False, write_content_size=False, write_dict_id=False)
        with_dictionary = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=options)
        sizes[lang] = model.priors[lang] + sum(len(with_dictionary.compress(raw[k : k + lang_id.BLOCK])) for k in range(0, len(raw), lang_id.BLOCK))
    best, *rest = sorted(sizes.items(), key=lambda x: (x[1], x[0]))
    return best[0], (rest[0][1] if rest else math.inf) - best[1] >= max(1, 0.002 * best[1])


def test_language_query(spark, docs):
    """Every row of the registered query against plain compression with the dictionaries of the rows that are not held out."""
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    model = lang_id.train(docs.where(~held))
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = lang_id.op2_language_id(spark, DATA).collect()
    assert len(got) == len(texts)
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert (r.lang_pred, r.accepted) == brute_language(model, texts[r.doc_id])


def test_many_and_tiny_languages(spark):
    rows = [(i, "ab" if i == 599 else f"wort{i} " * 9, f"l{i}") for i in range(600)] + [(None, "null key text", "l1")] * 3
    model = lang_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(model.dictionaries) == 600 and all(8 <= len(d) <= lang_id.DICTIONARY_BYTES for d in model.dictionaries.values())
    judge = lang_id.Compressors(lang_id.Model({"b": b"same words", "a": b"same words"}, {"a": 0.0, "b": 0.0}))
    assert judge.judge("tie") == ("a", 0.5, False)


# 3. Quality model


def test_quality_query(spark, docs):
    labels = spark.read.parquet(f"{DATA}/labels.parquet").select("doc_id", "quality")
    model = quality_mil.train(docs, labels.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2))
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = quality_mil.op3_quality_model(spark, DATA).collect()
    assert len(got) == len(texts)
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and r.predicted == (r.score >= 0.7)
        assert r.score == pytest.approx(brute_attention(model, texts[r.doc_id]), abs=1e-4)


def brute_attention(m, text):
    """One passage after the other, in double precision."""
    import math

    hidden = [np.maximum(x.astype(float) @ m.w1 + m.b1, 0) for x in quality_mil.encode_passages([text])[0]]
    weights = [math.exp(float((np.tanh(h @ m.v) / (1 + np.exp(-(h @ m.u)))) @ m.w)) for h in hidden]
    z = sum(w * h for w, h in zip(weights, hidden)) / sum(weights)
    return 1 / (1 + math.exp(-float(z @ m.c + m.b[0])))


def test_long_texts_in_parts(docs, spark):
    labels = spark.read.parquet(f"{DATA}/labels.parquet").select("doc_id", "quality")
    model = quality_mil.train(docs, labels)
    long = " ".join(r.text or "" for r in docs.select("text").collect())
    parts = quality_mil.segments(long, 20_000)
    assert "".join(parts) == long and len(parts) > 5 and all(len(p.split()) % 64 == 0 for p in parts[:-1])
    whole = quality_mil.score_texts(model, [long])[0]
    big = quality_mil.CHUNK_BYTES
    quality_mil.CHUNK_BYTES = 20_000
    try:
        assert quality_mil.score_texts(model, [None, long, "x"])[1] == pytest.approx(whole, abs=1e-3)
        assert quality_mil.segments(" " * 50_000, 1000) and quality_mil.segments("x" * 50_000, 1000) == ["x" * 50_000]
    finally:
        quality_mil.CHUNK_BYTES = big


def test_quality_model(spark, docs, odd):
    labels = spark.read.parquet(f"{DATA}/labels.parquet").select("doc_id", "quality")
    model = quality_mil.train(docs, labels)
    got = quality_mil.score(docs, model).join(labels, "doc_id").collect()
    good, bad = ([r.score for r in got if r.quality == q] for q in (1, 0))
    assert np.mean(good) > np.mean(bad) + 0.3
    scores = quality_mil.score(odd, model).collect()
    assert len(scores) == odd.count() and all(0 <= r.score <= 1 for r in scores)
    assert quality_mil.train(docs, labels.where("false")) is None
    assert quality_mil.score(odd, None).first().score == 0.5


def test_gradient():
    rng = np.random.default_rng(0)
    x, owner, y = rng.normal(size=(300, 6)).astype(np.float32), np.repeat(np.arange(100), 3), np.zeros(100, np.float32)
    y[:] = x.reshape(100, 3, 6)[:, :, 0].max(1) > 0.8
    m = quality_mil.fit(x, owner, y)
    logit = quality_mil.attend(m, x, owner, 100)[-1]
    assert ((logit > 0) == y).mean() > 0.85


# 4. Pages


def test_page_model():
    model = html_tree.PageModel(html_seed.labelled_pages())
    exact = sum(model.main_text(page) == " ".join(" ".join(t.split()) for t, c in blocks if c) for page, blocks in html_seed.labelled_pages(100, seed=5))
    assert exact >= 90
    page = "<html><head><title>t</title><script>var a='</p>'</script></head><body><nav><ul><li><a href=/>Home</a></li></ul></nav><article><h1>A &amp;  b</h1><p>One <b>t</b>wo.<br>three</article><div class='comments'><p>nice post</p></div><footer>&copy; x</footer>"
    assert model.main_text(page) == "A & b One two. three"
    for odd_page in (None, "", "<", "<a " * 500, "<div>" * 2000, "</p></div>", "<!-- <p>x</p>"):
        assert isinstance(model.main_text(odd_page), str)


def test_messages_are_exact():
    """Marginals by enumeration of all labels of a small tree."""
    model = html_tree.PageModel(html_seed.labelled_pages(60))
    tree = html_tree.Tree("<div class=menu><p>one two</p></div><p>three four five.</p>")
    n = len(tree.parent)
    total, on = 0.0, np.zeros(n)
    for code in range(2**n):
        y = [code >> i & 1 for i in range(n)]
        s = sum(y[i] * sum(model.own.get((tree.text[i] is not None, f), 0) for f in tree.features[i]) for i in range(n))
        s += sum(model.pair[tree.text[i] is not None][y[tree.parent[i]]][y[i]] for i in range(1, n))
        total += np.exp(s)
        on += np.exp(s) * np.array(y)
    assert np.allclose(model.marginals(tree), on / total)


def test_page_frames(spark):
    frame = spark.createDataFrame([(1, None, "x"), (2, "<p>hello there, this is a text.</p>", "y")], "page_id long, html string, text string")
    assert html_tree.extract_text(frame).count() == 2
    assert html_tree.extract_text(empty(frame)).columns == ["page_id", "html", "text", "n_chars"]


# 5. Packing


def test_pieces_equal_the_tokenizer(spark, odd):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    plain = Tokenizer.from_file(path)
    rows = packing.tokenized_pieces(odd, path).collect()
    whole = collections.defaultdict(bytes)
    for r in sorted(rows, key=lambda r: r.start):
        assert r.length * 4 == len(r.ids) and r.length <= 4096
        whole[r.doc_id] += bytes(r.ids)
    for i, text in enumerate(ODD):
        assert whole[i] == np.array(plain.encode(text or "", add_special_tokens=False).ids + [1], "<u4").tobytes()
    packed = packing.pack(packing.tokenized_pieces(odd, path).drop("ids")).collect()
    bins = collections.defaultdict(list)
    for r in packed:
        bins[r.sequence_id].append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(packed) == len(rows)
    assert packing.pack(packing.tokenized_pieces(empty(odd), path).drop("ids")).count() == 0


def test_sum_of_squares_is_tight():
    sizes = np.array(random.Random(3).choices(range(20, 3000), k=3000))
    bins, offsets, n = packing.sum_of_squares(sizes, 4096)
    load = np.bincount(bins, sizes, n)
    assert load.max() <= 4096 and n <= -(-sizes.sum() // 4096) * 1.01 + 1


# 6. Rules


def brute_stats(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    counts = collections.Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    marked = {j for i in range(len(words) - 2) if counts[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(marked)


def test_rule_statistics(spark, docs, odd):
    both = docs.select("doc_id", "text").union(odd.select("doc_id", "text"))
    texts = collections.defaultdict(list)
    for r in both.collect():
        texts[r.doc_id].append(r.text)
    for r in quality_rules.quality_stats(both).collect():
        want = [brute_stats(t) for t in texts[r.doc_id]]
        got = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
        assert got in want
        assert r.base_failed == (got[0] < 50 or 100 * got[4] > 50 * got[0])
        assert not (r.base_failed and r.kept)


def test_order_never_changes_a_verdict(docs):
    texts = [r.text for r in docs.select("text").collect()]
    rules = quality_rules.BASE_RULES + quality_rules.MORE_RULES
    cascade = quality_rules.Cascade(rules, 50)
    assert [cascade.rejects(quality_rules.Text(t)) for t in texts] == [any(r.rejects(quality_rules.Text(t)) for r in rules) for t in texts]
    assert {r.name for r in cascade.rules} == {r.name for r in rules}


def test_filter_keeps_columns(odd):
    assert quality_rules.quality_filter(odd).columns == odd.columns
    assert quality_rules.quality_filter(empty(odd)).count() == 0


# 7. SentencePiece


def test_pieces_equal_the_library(spark, docs, odd):
    import public_tokenizers
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    both = docs.select("doc_id", "text").union(odd.select("doc_id", "text").where("doc_id < 50").withColumn("doc_id", F.col("doc_id") + 10**6))
    texts = dict(both.collect())
    encoded = sentence_pieces.encode_texts(both, path)
    decoded = dict(sentence_pieces.decode_ids(encoded, path).collect())
    for i, ids, _ in encoded.collect():
        assert list(ids) == library.encode(texts[i] or "")
        assert decoded[i] == (texts[i] or "")


def best_sum(pieces, text):
    """All pieces tried at all positions of the whole text."""
    n = len(text)
    best = [0.0] + [-float("inf")] * n
    longest = max(map(len, pieces.id_of))
    for end in range(1, n + 1):
        for begin in range(max(0, end - longest), end):
            piece = text[begin:end]
            if piece in pieces.usable:
                best[end] = max(best[end], best[begin] + pieces.score[pieces.id_of[piece]])
        best[end] = max(best[end], best[end - 1] + pieces.lowest)
    return best[n]


def test_best_sums_against_all_pieces(docs):
    import public_tokenizers
    import pyarrow as pa

    pieces = sentence_pieces.pieces_of(public_tokenizers.path("piece_bpe_32k.model"))
    pieces.usable = {p for p in pieces.id_of if p in pieces.automaton}
    r = random.Random(12)
    texts = [(t or "")[:1500] for t in ODD] + [r.choice(x.text or " ")[:1] + (x.text or "")[:1200] for x in docs.select("text").limit(60).collect()]
    texts += ["".join(r.choice("ab t h e\n\t▁.,1日é\x00👍") for _ in range(50)) for _ in range(100)]
    for text, (_, best) in zip(texts, pieces.encode_column(pa.array(texts))):
        assert best == pytest.approx(best_sum(pieces, pieces.processor.normalize(text)))


def as_unigram(raw):
    """The same pieces and scores as a unigram model."""
    trainer = dict(sentence_pieces._fields(raw))[2]
    at = raw.index(trainer) + trainer.index(bytes([0x18, 2]))
    return raw[: at + 1] + bytes([1]) + raw[at + 2 :]


def test_unigram_equals_the_library(docs):
    import public_tokenizers
    import pyarrow as pa
    import sentencepiece

    raw = as_unigram(open(public_tokenizers.path("piece_bpe_32k.model"), "rb").read())
    ours, library = sentence_pieces.Pieces(raw), sentencepiece.SentencePieceProcessor(model_proto=raw)
    assert ours.kind == sentence_pieces.UNIGRAM
    words = sorted({w for x in docs.select("text").limit(80).collect() for w in (x.text or "").split()})[:4000] + ["thing", "über", "日本", "", "a", "日本👍x"]
    same = 0
    for word, (ids, best) in zip(words, ours.encode_column(pa.array(words))):
        a, b = np.frombuffer(ids, "<u4").tolist(), library.encode(word)
        same += a == b
        if ours.unknown not in b and not any(i in set(ours.byte_ids) for i in b):  # the library adds in single precision
            assert best == pytest.approx(sum(ours.score[i] for i in a)) and best >= sum(ours.score[i] for i in b) - 1e-6
        assert ours.decode(a) == word
    assert same >= 0.99 * len(words)


def test_runs_of_unknown_characters():
    """Without byte pieces a run of unknown characters is one id."""
    import public_tokenizers

    pieces = sentence_pieces.Pieces(as_unigram(open(public_tokenizers.path("piece_bpe_32k.model"), "rb").read()))
    pieces.byte_ids = [-1] * 256
    ids, best = pieces.path("▁a\ue000\ue001\ue002b")
    assert ids.count(pieces.unknown) == 1 and best < 3 * pieces.lowest + 1


def test_sentencepiece_query(spark):
    import public_tokenizers
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    got = sentence_pieces.op7_sentencepiece(spark, DATA).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = library.encode(texts[r.doc_id])
        assert (r.n_ids, r.ids_crc32, r.decoded_crc32) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), zlib.crc32(texts[r.doc_id].encode()))


# 8. Near duplicates


def brute_components(rows):
    sets = {}
    for i, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[i] = frozenset(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else frozenset()
    ids, root = sorted(sets), {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def near_copies(n=60):
    r = random.Random(4)
    word = lambda: "".join(r.choices("abcdefgh", k=4))
    passage = [word() for _ in range(60)]
    rows = []
    for i in range(n):
        kind = i % 4
        if kind == 0:
            words = [word() for _ in range(80)]
        elif kind == 1:
            words = passage + [word() for _ in range(r.randint(2, 25))]
        elif kind == 2:
            words = list(rows[-1][1].split())
            for _ in range(r.randint(0, 4)):
                words[r.randrange(len(words))] = word()
        else:
            words = [w.upper() for w in rows[r.randrange(len(rows))][1].split()]
        rows.append((i, " ".join(words)))
    return rows + [(500, None), (501, ""), (502, "one two"), (503, "One  two"), (504, "one")]


@pytest.mark.parametrize("split", [False, True])
def test_components_against_brute_force(spark, monkeypatch, split):
    if split:  # all neighbourhoods too large for one task, lists in several blocks
        monkeypatch.setattr(shingle_join, "TOGETHER_SETS", 1)
        monkeypatch.setattr(shingle_join, "BLOCK", 3)
    rows = near_copies()
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit("clash"))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in shingle_join.similar_documents(frame).collect()}
    assert got == brute_components(rows)
    assert len({c for _, c in got.values()}) < len(rows) - 10


def test_drop_similar(spark, odd):
    rows = near_copies(20)
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("rep", F.lit(1))
    kept = shingle_join.drop_similar(frame)
    assert {r.doc_id for r in kept.collect()} == {i for i, (_, c) in brute_components(rows).items() if i == c}
    assert kept.columns == frame.columns
    assert shingle_join.similar_documents(odd).count() == odd.count()
    assert shingle_join.similar_documents(empty(odd)).count() == 0


def test_odd_ids(spark):
    """Rows without an id that link two others, one id with two texts, and a text that most rows have."""
    words = [f"w{i}" for i in range(60)]
    bridge, left = " ".join(words), " ".join(words[:57])
    far = " ".join(f"z{i}" for i in range(60))
    rows = [(1, " ".join(words[:54])), (None, bridge), (2, " ".join(words[6:])), (5, far), (5, left), (9, far), (10, None)]
    rows += [(100 + i, "hot " * 9) for i in range(2000)] + [(4000, None)] * 3 + [(None, "")] * 3
    out = collections.Counter(tuple(r) for r in shingle_join.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    want = [(1, 50, 1), (None, 56, 1), (2, 50, 1), (5, 56, 5), (5, 53, 1), (9, 56, 5), (10, 0, 10)] + [(100 + i, 1, 100) for i in range(2000)] + [(4000, 0, 4000)] * 3 + [(None, 0, None)] * 3
    assert out == collections.Counter(want)


def test_words_that_defeat_polynomials_stay_apart(spark):
    """Thue-Morse words of 2048 signs are equal under any polynomial hash modulo 2^64."""
    word = "a"
    for _ in range(11):
        word += word.translate(str.maketrans("ab", "ba"))
    rows = [(1, word), (2, word.translate(str.maketrans("ab", "ba")))]
    assert [r.component_id for r in shingle_join.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).orderBy("doc_id").collect()] == [1, 2]


def test_hot_shingles(spark, monkeypatch):
    monkeypatch.setattr(shingle_join, "ROUTING_SAMPLE", 1)
    monkeypatch.setattr(shingle_join, "HOT_SHARE", 2)
    rows = near_copies(240)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in shingle_join.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_components(rows)


def test_connected_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 90), (90, 95), (7, 7), (None, 3)]
    got = dict(connected_components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**{i: 1 for i in range(1, 41)}, 90: 90, 95: 90, 100: 90}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# 9. Shards


def smallest_capacity(sizes, shards):
    low, high = max(sizes), sum(sizes)
    while low < high:
        mid, used, load = (low + high) // 2, 1, 0
        for s in sizes:
            if load + s > mid:
                used, load = used + 1, 0
            load += s
        low, high = (low, mid) if used <= shards else (mid + 1, high)
    return low


@pytest.mark.parametrize("hot", [False, True])
def test_shards_are_minimax(spark, hot):
    r = random.Random(7)
    rows = [(i, f"g{r.randrange(400)}", r.randint(1, 50)) for i in range(1500)] + [(5000 + i, "hot", 40) for i in range(900 if hot else 0)] + [(9000, None, 1), (9001, None, 1)]
    frame = spark.createDataFrame(rows, "doc_id long, g string, s long").withColumn("key", F.lit("clash"))
    out = sharding.shard_by_size(frame, F.col("g"), F.col("s")).collect()
    assert len(out) == len(rows)
    shard_of, load, slots = {}, collections.Counter(), collections.defaultdict(list)
    for x in out:
        assert shard_of.setdefault(x.g, x.shard) == x.shard
        load[x.shard] += x.size
        slots[x.shard].append(x.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    total = sum(load.values())
    rest = [v for v in load.values() if v <= total / 16 * 1.5]
    assert max(rest) <= sum(rest) / len(rest) + 100
    assert sharding.shard_by_size(empty(frame), F.col("g"), F.col("s")).count() == 0


def test_capacity_is_the_smallest(spark):
    r = random.Random(8)
    groups = [(r.getrandbits(62), r.randint(1, 30)) for _ in range(3000)]
    frame = spark.createDataFrame(groups, "key long, size long")
    assert sharding.minimax_cuts(frame, 16)[2] == smallest_capacity([s for _, s in sorted(groups)], 16)


# 10. URLs


def plain_judge(url):
    host, path = ("", "") if url is None or "://" not in url else re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url).groups()
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [(len(h + p), h + p, a) for a, h, p in url_rules.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, None, None))
    return host, path, best[1], best[2]


def test_url_rules(spark):
    urls = [None, "", "no scheme", "http://A.Example.COM/en/7x?q#f", "https://net/de/1", "x://example.net/de/8/9", "x://notexample.net/de/8", "http://org/es/", "http://com?x=/en/", "ftp://a://b/en/", "http://çÉ.com/en/\nz"]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string").withColumn("bad", F.lit("clash"))
    labels = spark.createDataFrame([], "page_id long, bad boolean")
    for r in url_rules.judge_urls(pages, labels).collect():
        host, path, rule, action = plain_judge(r.url)
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule, action or "allow")
    assert url_rules.judge_urls(empty(pages), labels).count() == 0


def test_mined_rules_block(spark):
    rows = [(i, f"http://{'spam' if i % 3 == 0 else 'fine'}.example.net/x/{i}", i % 3 == 0) for i in range(300)]
    frame = spark.createDataFrame(rows, "page_id long, url string, is_bad boolean")
    out = url_rules.judge_urls(frame.select("page_id", "url"), frame.select("page_id", F.col("is_bad").alias("bad"))).collect()
    assert all((r.verdict == "block") == (r.page_id % 3 == 0) for r in out)


def brute_rules(baskets, min_rows, min_confidence):
    """All token combinations by counting, with the Wilson bound as in a textbook."""
    import itertools
    import math

    counts, bad = collections.Counter(), collections.Counter()
    for tokens, is_bad in baskets:
        for size in range(1, len(tokens) + 1):
            for items in itertools.combinations(sorted(tokens), size):
                counts[items] += 1
                bad[items] += is_bad
    base, z, out = sum(b for _, b in baskets) / len(baskets), url_rules.CHANCE, {}
    for items, n in counts.items():
        p = bad[items] / n
        low = (p + z * z / (2 * n) - z * math.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)
        if bad[items] >= min_rows and p >= min_confidence and low > base:
            out[items] = p
    return out


def test_mining_against_counts(spark):
    r = random.Random(6)
    baskets = []
    for _ in range(1500):
        tokens = [t for t in "abcdef" if r.random() < 0.4] or ["a"]
        baskets.append((tokens, r.random() < (0.9 if "b" in tokens and "c" in tokens else 0.7 if "e" in tokens else 0.2)))
    frame = spark.createDataFrame(baskets, "tokens array<string>, bad boolean")
    got = {tuple(sorted(x.antecedent)): x.confidence for x in url_rules.mine_rules(frame).collect()}
    want = brute_rules(baskets, 20, 0.5)
    assert got == pytest.approx(want) and len(want) > 10
    r.shuffle(labels := [b for _, b in baskets])
    noise = spark.createDataFrame([(t, b) for (t, _), b in zip(baskets, labels)], "tokens array<string>, bad boolean")
    assert url_rules.mine_rules(noise).count() == 0


def test_url_query(spark):
    urls = {r.page_id: r.url for r in spark.read.parquet(f"{DATA}/pages.parquet").collect()}
    got = url_rules.op10_url_filter(spark, DATA).collect()
    assert len(got) == len(urls)
    for r in got:
        host, path, rule, action = plain_judge(urls[r.page_id])
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule, action or ("block" if r.learned else "allow"))


def test_url_clashes(spark):
    pages = spark.createDataFrame([(1, "http://a.com/en/x" + "y" * 100_000)], "page_id long, url string").withColumns({c: F.lit(1) for c in ("learned", "hit", "HOST", "confidence", "_action", "tokens")})
    row = url_rules.judge_urls(pages, spark.createDataFrame([], "page_id long, bad boolean")).first()
    assert row.host == "a.com" and row.learned is None and row.hit == 1 and row.verdict == "block" and len(row.path) > 100_000


# The pipeline


def test_pipeline(spark):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "language_id", "near_duplicates", "packing"]
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rules = quality_rules.BASE_RULES + quality_rules.MORE_RULES
    kept = [r for r in docs.collect() if not any(x.rejects(quality_rules.Text(r.text)) for x in rules)]
    judge = lang_id.Compressors(lang_id.train(spark.createDataFrame(kept, docs.schema)))
    kept = [(r.doc_id, r.text) for r in kept if judge.judge(r.text)[2]]
    want = {i for i, (_, c) in brute_components(kept).items() if i == c}
    out = corpus_pipeline.run(spark, DATA).collect()
    assert {r.doc_id for r in out} == want
    assert sum(r.length for r in out) <= len({r.sequence_id for r in out}) * 4096
    ids = {i: t for i, t in kept}
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces, places = collections.defaultdict(dict), collections.defaultdict(list)
    for r in out:
        pieces[r.doc_id][r.piece] = r
        places[r.sequence_id].append((r.offset, r.length))
    for i in want:
        encoded = [*library.encode(ids[i] or "", add_special_tokens=False).ids, 1]
        parts = [encoded[k : k + 4096] for k in range(0, len(encoded), 4096)]
        assert [(r.piece, r.start, r.length, r.ids_crc32) for _, r in sorted(pieces[i].items())] == [(k, 4096 * k, len(p), zlib.crc32(np.array(p, "<u4").tobytes())) for k, p in enumerate(parts)]
    for spans in places.values():  # gapless from 0
        assert [a for a, _ in sorted(spans)] == list(np.cumsum([0] + [n for _, n in sorted(spans)])[:-1])


def test_pipeline_stages_on_odd_rows(spark):
    """Nulls, empty tables, repeated rows and columns with clashing names pass through every stage."""
    import corpus_pipeline

    text = " ".join(f"river{i} runs{i * 7} sea{i * 3}" for i in range(40))
    rows = [(None, text, None, None, 1), (1, None, "en", "a", None), (2, "", "en", "a", 0), (3, text, "en", "a", 5), (3, text, "en", "a", 5), (4, text + " end", None, "b", 5), (5, "日本" * 200_000, "xx", None, 1)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns({c: F.lit("clash") for c in ("group", "kept", "component", "size", "piece_", "score", "n_words")})
    for docs in (frame, empty(frame)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, DATA)
            assert name == "packing" or out.columns == frame.columns
            assert docs.take(1) or not out.take(1)
    kept = corpus_pipeline.near_duplicates(spark, corpus_pipeline.quality_rules(spark, frame, DATA), DATA).collect()
    assert {r.doc_id for r in kept} == {None, 3}
    packed = corpus_pipeline.packing(spark, frame, DATA).collect()
    assert collections.Counter(r.doc_id for r in packed if r.piece == 0) == collections.Counter(r[0] for r in rows)


def test_quality_scores_do_not_depend_on_cuts(spark, monkeypatch):
    rng = np.random.default_rng(9)
    shape = lambda *n: rng.normal(size=n).astype(np.float32)
    model = quality_mil.Model(shape(quality_mil.FEATURES, 24), shape(24), shape(24, 12), shape(24, 12), shape(12), shape(24) / 9, shape(1))
    words = ["Some", "words,", "é12", "and!", "(more)", "\n", "a.b"]
    long = " ".join(words[i] for i in rng.integers(0, 7, 200_000).tolist())
    texts = [long, None, "", " \n ", "short one", "x" * 3000 + " " + long[:5000], long[:70_000]]
    whole = quality_mil.score_texts(model, texts)
    for size in (500, 10_000, 1 << 24):
        monkeypatch.setattr(quality_mil, "CHUNK_BYTES", size)
        monkeypatch.setattr(quality_mil.segments, "__defaults__", (size,))
        assert (quality_mil.score_texts(model, texts) == whole).all()
    assert (np.concatenate([quality_mil.score_texts(model, [t]) for t in texts]) == whole).all()


def test_shards_of_the_query(spark):
    """Every column that the contract fixes, and that no shard is larger than the smallest capacity for the order that was taken."""
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    rows = sharding.op9_sharding(spark, DATA).collect()
    assert len(rows) == len(texts) and {r.law for r in rows} == {"bytes"} and {r.grown_shard for r in rows} == {None}
    shard_of, slots, load = {}, collections.defaultdict(list), collections.Counter()
    for r in rows:
        raw = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32) == (len(raw) + 1, zlib.crc32(raw)) and 0 <= r.shard < 16
        assert shard_of.setdefault(raw, r.shard) == r.shard
        slots[r.shard].append(r.slot)
        load[r.shard] += r.size
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    sizes = collections.Counter()
    for t in texts.values():
        sizes[t] += len(t.encode()) + 1
    assert max(load.values()) - sum(load.values()) / 16 <= max(max(sizes.values()), sum(load.values()) / 16 / 8)


def test_shards_of_odd_rows(spark):
    rows = [(None, "t" * (i % 7)) for i in range(300)] + [(7, "same") for _ in range(200)] + [(8, None), (9, ""), (10, "日" * 200_000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("slot", "SHARD", "size", "key", "number", "bucket", "large", "n", "start")})
    out = sharding.shard_by_size(frame, F.coalesce("text", F.lit("")), F.octet_length(F.coalesce("text", F.lit(""))) + 1, 5)
    assert sorted(c.lower() for c in out.columns) == sorted(c.lower() for c in frame.columns)
    slots = collections.defaultdict(list)
    for r in out.select("shard", "slot", "key").collect():
        slots[r.shard].append(r.slot)
        assert r.key == "clash"
    assert sum(map(len, slots.values())) == len(rows) and all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_rules_of_common_paths_do_not_explode(spark):
    """40 tokens that always come together are one item: as many rules as without them, and any of them stands for all."""
    shared = [f"path:p{i}" for i in range(40)]
    rows = [(shared + ["path:x"], True)] * 60 + [(shared, False)] * 60 + [(["host:a", f"path:n{i}"], False) for i in range(80)]
    found = url_rules.mine_rules(spark.createDataFrame(rows, "tokens array<string>, bad boolean")).collect()
    want = {frozenset({"path:x"}): 1.0, frozenset({"path:x", "path:p0"}): 1.0, frozenset({"path:p0"}): 0.5}
    base, z = 60 / 200, url_rules.CHANCE
    low = lambda p, n: (p + z * z / (2 * n) - z * (p * (1 - p) / n + z * z / (4 * n * n)) ** 0.5) / (1 + z * z / n)
    want = {k: v for k, v in want.items() if low(v, 60 if v == 1 else 120) > base}
    assert {frozenset(r.antecedent): r.confidence for r in found} == want
    assert all(set(shared) in map(set, r.classes) for r in found if "path:p0" in r.antecedent)
    urls = spark.createDataFrame([("u", ["path:x"]), ("v", ["path:p7", "path:x"]), ("w", ["path:p7"])], "url string, tokens array<string>")
    assert {r.url for r in url_rules.matched_urls(urls, url_rules.mine_rules(spark.createDataFrame(rows, "tokens array<string>, bad boolean"))).collect()} >= {"u", "v"}


def test_quality_and_language_of_null_ids(spark):
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    frame = spark.createDataFrame([(None, "one text", "en"), (1, "another text", "en")], "doc_id long, text string, lang string")
    import tempfile

    where = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    frame.write.parquet(f"{where}/documents.parquet")
    labels.write.parquet(f"{where}/labels.parquet")
    assert {r.held_out for r in quality_mil.op3_quality_model(spark, where).where("doc_id is null").collect()} == {False}
    assert {r.held_out for r in lang_id.op2_language_id(spark, where).where("doc_id is null").collect()} == {False}
