"""Quality, packing, mixing, token counts, URL filter and the pipeline on small tables with every odd case."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from checks import Check
from checks.verify import compare, connect
from tokenizers import Tokenizer

import corpus_pipeline
from ratetally.llm import quality, queries
from ratetally.llm.mixing import mix
from ratetally.llm.packing import WordEncoder, best_fit, pack_documents
from ratetally.llm.tokens import allot, section_tokens
from ratetally.llm.urlrules import filter_urls

SMALL = "/root/testdata/sf0.001"
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
ODD = [(900, None), (901, ""), (902, " \t\n"), (903, "It's <|endoftext|> Ünï. C'S x!? é."), (903, "It's <|endoftext|> Ünï. C'S x!? é."), (None, "no id"), (904, "a.b, İ ﬁ ́ʼ . ,a 1.5; 's, x's."), (905, "word " * 9000)]


@pytest.fixture
def docs(spark):
    names = "taken long, target string, source_size string, score string, predicted string, _text string, id long, section long, size long"
    return lambda rows: spark.createDataFrame([(i, t, None, 1, "t", "s", None, None, None, 7, 8, 9) for i, t in rows], f"doc_id long, text string, source string, {names}")


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_queries_agree_with_their_sql(spark, name):
    assert compare(spark, connect(SMALL), SMALL, name, Check(queries.QUERIES[name], queries.SQL[name])) == ""


def test_quality_is_learnt_from_training_rows_only_and_holds_on_others(spark):
    folder = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    got = queries.op2_quality_classifier(spark, folder).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)
    held = [r["predicted"] == labels[r["doc_id"]] for r in got if r["held_out"] and r["doc_id"] in labels]
    assert len(held) > 50 and np.mean(held) > 0.95


def test_quality_of_odd_texts_and_without_labels(spark, docs):
    table = docs(ODD)
    labels = spark.createDataFrame([(903, 1), (904, None), (None, 0), (12345, 0), (905, 0), (905, 1)], "doc_id long, quality int")
    got = quality.score(table, quality.train(table, labels))
    assert got.count() == len(ODD) and got.columns[-3:] == ["held_out", "score", "predicted"]
    assert quality.train(table, labels.limit(0)) is None
    assert {r["score"] for r in quality.score(table, None).collect()} == {0.5}
    assert quality.score(docs([]), None).count() == 0


def test_attention_gradients():
    rng = np.random.default_rng(0)
    x, starts, y = rng.normal(size=(9, 4)), np.array([0, 2, 3]), np.array([1.0, 0.0, 1.0])
    p = {"encode": rng.normal(size=(4, 3)), "encode_bias": rng.normal(size=3), "v": rng.normal(size=(3, 2)), "u": rng.normal(size=(3, 2)), "w": rng.normal(size=2), "out": rng.normal(size=3), "out_bias": np.zeros(1)}

    def loss():
        s = quality._forward(x, starts, p)[0]
        return np.mean(np.log1p(np.exp(-s)) * y + np.log1p(np.exp(s)) * (1 - y))

    g = quality._gradients(x, starts, y, p)
    for k in p:
        i = tuple(0 for _ in p[k].shape)
        p[k][i] += 1e-6
        up = loss()
        p[k][i] -= 2e-6
        assert abs((up - loss()) / 2e-6 - g[k][i]) < 1e-6
        p[k][i] += 1e-6


def test_best_fit_takes_the_tightest_open_window():
    rng = random.Random(2)
    lengths = sorted((rng.randrange(1, 101) for _ in range(400)), reverse=True)
    bins, offsets = best_fit(lengths, 100)
    room, want = [], []
    for n in lengths:
        fitting = [r for r in room if r >= n]
        if fitting:
            b = min((i for i, r in enumerate(room) if r == min(fitting)))
            want.append(min(fitting))
        else:
            room.append(100)
            b = len(room) - 1
            want.append(100)
        room[b] -= n
    assert len(set(bins)) == len(room)
    assert [100 - o for o in offsets] == want


def test_packing_is_an_exact_cover(spark, docs):
    rows = ODD + [(i, f"text number {i} " * (i % 40)) for i in range(150)]
    got = pack_documents(docs(rows), WORD_BPE).collect()
    tokenizer = Tokenizer.from_file(WORD_BPE)
    want = []
    for i, t in rows:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        want += [(i, s, len(ids[s : s + 4096]), zlib.crc32(ids[s : s + 4096].tobytes()), len(ids)) for s in range(0, len(ids), 4096)]
    assert sorted(map(str, want)) == sorted(str(tuple(r)[:5]) for r in got)
    sequences = {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))] and sum(n for _, n in parts) <= 4096
    assert len(sequences) == -(-sum(r["length"] for r in got) // 4096)
    assert pack_documents(docs([]), WORD_BPE).count() == 0


def test_ids_are_those_of_the_whole_text():
    tokenizer = Tokenizer.from_file(WORD_BPE)
    texts = ["<|ENDOFTEXT|> x", "<|endoftext|> X", "A<|endoftext|>.B <|StartOfText|>, <|startoftext|>", "T\u0308 a", "J\u030c, H\u0331! W\u030a Y\u030a.", "ΟΔΟΣ. ΣΑΣ", "İI I\u0307", "\u1e9e K Å", "IT'S It's\x0bA\x0cB\x1fC\x85D\u00a0E \u0301x", "The THE the ÜBER Über, Über", "x\u2028Y \ufeffZ", "Don'T 'S DON'T! É E\u0301 ."]
    rng = random.Random(6)
    parts = ["<|", "|>", "endoftext", "ENDOFTEXT", "T", "J", "a", "B", "'S", "'t", ".", ",!", " ", "\n", "\t", "\u0308", "\u030c", "\u0338", "<", "É", "Σ", "3", "\x0b", "\u3000", "İ"]
    texts += ["".join(rng.choices(parts, k=rng.randrange(1, 14))) for _ in range(3000)]
    got = WordEncoder(WORD_BPE).encode(texts)
    wrong = [t for t, ids in zip(texts, got) if np.frombuffer(ids, "<u4").tolist() != tokenizer.encode(t, add_special_tokens=False).ids]
    assert wrong == []


def test_mix_reaches_its_targets(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice(["a", "b", "c", None, "é", "tiny"]), rng.choice([0, 1, 5, 300, None])) for i in range(400)] + [(7, "a", 5), (7, "a", 5), (None, "b", 5), (900, "zero", 0)]
    table = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, source string, size long, taken string, _slice string")
    out = mix(table)
    got = out.collect()
    assert len(got) == len(rows) and sorted(map(tuple, got), key=str) == sorted(map(tuple, mix(table.repartition(7)).collect()), key=str)
    total = sum(r[2] or 0 for r in rows)
    size = {}
    for _, s, n in rows:
        size[s] = size.get(s, 0) + (n or 0)
    order = sorted([s for s in size if s is not None], key=lambda s: s.encode()) + [None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, free, left = {}, set(size), 1.5 * total
    while True:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * level > 2 * size[s]}
        if not over:
            break
        target |= {s: 2.0 * size[s] for s in over}
        left -= sum(2 * size[s] for s in over)
        free -= over
    target |= {s: level * weight[s] for s in free}
    for s in size:
        own = [r for r in got if r["source"] == s]
        assert {r["source_size"] for r in own} == {size[s]} and all(abs(r["target"] - target[s]) < 1e-6 for r in own)
        assert abs(sum(r["taken"] for r in own) - target[s]) <= 0.5
        assert all(0 <= r["taken"] <= 2 * (r["size"] or 0) for r in own)
    assert mix(table.limit(0)).count() == 0


def test_mix_leaves_columns_of_any_name_alone(spark):
    names = ("_slice", "_goal", "_times", "_edge", "_rest", "_md5", "_i", "_src", "_row")
    rows = [(i, "ab"[i % 2], i, *[f"{n}{i}" for n in names]) for i in range(50)]
    table = spark.createDataFrame(rows, "doc_id long, source string, size long, " + ", ".join(f"{n} string" for n in names))
    got = mix(table)
    assert got.columns == [*table.columns, "source_size", "target", "taken"]
    assert sorted(map(tuple, got.select(table.columns).collect())) == sorted(rows)


def test_tokens_of_sections(spark, docs):
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    rows = ODD + [(1, "a\n\n\n  b\nc"), (2, "\n"), (3, "é√\n\n\n\n𝄞 x\r\n"), (4, "x" * 5000 + "\n" + "y")]
    for rule in ("start", "end", "most"):
        got = section_tokens(docs(rows), ranks, public_tokenizers.PATTERN, rule).collect()
        from ratetally.llm.tokens import encoding

        encode, _ = encoding(ranks, public_tokenizers.PATTERN)
        for i in (1, 2, 3, 4):
            text = dict(rows)[i]
            own = sorted((r for r in got if r["doc_id"] == i), key=lambda r: r["section"])
            assert "".join(text[r["start"] : r["start"] + r["length"]] for r in own) == text
            parts = [line + "\n" for line in text.split("\n")]
            assert len(own) == len(parts) - (text[-1] == "\n")
            assert sum(r["n_tokens"] for r in own) == len(encode.encode_ordinary(text))
        assert [(r["n_tokens"], r["length"]) for r in got if r["doc_id"] in (900, 901)] == [(0, 0)] * 2
    assert section_tokens(docs([]), ranks, public_tokenizers.PATTERN).count() == 0


def test_crossing_tokens_follow_the_rule():
    bounds, ends = np.array([0, 2, 3, 10, 12]), np.array([1, 4, 9, 12])
    assert allot(bounds, ends, "start").tolist() == [0, 0, 2, 2]
    assert allot(bounds, ends, "end").tolist() == [0, 2, 2, 3]
    assert allot(bounds, ends, "most").tolist() == [0, 0, 2, 3]


URLS = [
    None, "", "no scheme/en/", "http://", "HTTP://WWW.Example.COM/en/x", "http://www.example.com/en/", "http://example.com/en/1?q", "https://m.example.com/en", "http://a.net/es/", "http://a.net/fr/1#x",
    "http://a.net?x=/fr/", "http://net/fr/", "http://anet/fr/", "http://com", "http://com/", "x://y.org/://z.com/", "http://b.org/fr/1", "http://é.com/É", "http://a.com\n/x",
]


def judged(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
    host, path = rest[:cut].encode().lower().decode(), rest[cut:]
    path = path[: min([path.index(c) for c in "?#" if c in path], default=len(path))]
    fits = [(h + p, v) for v, h, p in queries.LISTED_URLS if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *max(fits, key=lambda f: len(f[0]), default=(None, None)))


def test_url_filter(spark):
    urls = URLS + [f"http://h{i % 5}.net/fr/{i}" for i in range(40)] + [f"http://h{i % 5}.com/en/{i}" for i in range(40)]
    pages = spark.createDataFrame([(i, u, "h", "p") for i, u in enumerate(urls)], "page_id long, url string, host string, path string")
    got = {r["page_id"]: r for r in filter_urls(pages, queries.LISTED_URLS).collect()}
    for i, url in enumerate(urls):
        host, path, rule, verdict = judged(url)
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, rule), url
        assert got[i]["verdict"] == verdict if verdict else got[i]["verdict"] in ("allow", "block")
    by_url = {u: got[i] for i, u in enumerate(urls)}
    assert by_url["http://b.org/fr/1"]["verdict"] == "block" and by_url["http://b.org/fr/1"]["mined_rule"]
    assert filter_urls(pages.limit(0), queries.LISTED_URLS).count() == 0
    assert {r["verdict"] for r in filter_urls(pages.where("page_id < 4"), queries.LISTED_URLS).collect()} == {"allow"}


def test_near_duplicates_of_rows_that_share_or_lack_ids(spark):
    words = lambda a, b: " ".join(f"w{i}" for i in range(a, b))
    stay = [(None, words(0, 60)), (None, words(100, 160)), (5, words(200, 260)), (5, words(300, 360)), (1, words(500, 560)), (7, ""), (7, ""), (None, None)]
    go = [(None, words(501, 561)), (9, words(502, 562)), (None, words(101, 161) + " x")]
    rows = stay + [(1, words(500, 560)), (5, words(200, 260))] + go[:2]
    table = lambda some: spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in some], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.near_duplicates(spark, table(rows), SMALL).collect()
    assert sorted(((r["doc_id"], r["text"]) for r in got), key=str) == sorted(stay, key=str)
    # A text without an id that is like one with an id goes alone.
    got = corpus_pipeline.near_duplicates(spark, table(stay[:2] + [(3, go[2][1])]), SMALL).collect()
    assert sorted(((r["doc_id"], r["text"]) for r in got), key=str) == sorted([stay[0], (3, go[2][1])], key=str)
    assert corpus_pipeline.near_duplicates(spark, table([]), SMALL).count() == 0


def test_pipeline_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns = docs.columns
    tables = [docs]
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, tables[-1], SMALL).write.parquet(f"{tmp_path}/{number}")
        tables.append(spark.read.parquet(f"{tmp_path}/{number}"))
    assert all(t.columns == columns and t.dtypes == docs.dtypes for t in tables[:-1])
    texts = [{r["doc_id"]: r["text"] for r in t.collect()} for t in tables[:-1]]
    # Lines: nothing but lines is lost, and no line of at least 24 characters is left twice.
    assert set(texts[2]) <= set(texts[1]) <= set(texts[0])
    left = [line for t in texts[2].values() for line in t.split("\n") if line.strip()]
    assert len(left) == len(set(left))
    for i, t in texts[2].items():
        own = iter(texts[1][i].split("\n"))
        assert all(line in own for line in t.split("\n"))
    # Near duplicates: no two that stay are alike, and everyone who went has a like.
    sets = {}
    for i, t in texts[2].items():
        words = t.encode().lower().split()
        sets[i] = {tuple(words[j : j + 5]) for j in range(max(1, len(words) - 4))} if words else set()
    alike = lambda a, b: a != b and sets[a] & sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    assert not any(alike(a, b) for a in texts[3] for b in texts[3])
    assert all(any(alike(a, b) for b in texts[2]) for a in set(texts[2]) - set(texts[3]))
    # Mixing: one and a half times all words, no document more than twice.
    words = lambda t: len(t.encode().split())
    mixed = tables[4].select("doc_id", "text").collect()
    total = sum(words(t) for t in texts[3].values())
    assert abs(sum(words(r["text"]) for r in mixed) - 1.5 * total) <= 40
    taken = {}
    for r in mixed:
        taken[r["doc_id"]] = taken.get(r["doc_id"], 0) + words(r["text"])
    assert all(n <= 2 * words(texts[3][i]) for i, n in taken.items())
    # Packing: as many tokens as the mixed texts have.
    tokenizer = Tokenizer.from_file(WORD_BPE)
    assert tables[5].groupBy().sum("length").first()[0] == sum(len(tokenizer.encode(r["text"], add_special_tokens=False).ids) + 1 for r in mixed)
    assert corpus_pipeline.run(spark, SMALL).count() == tables[5].count()


def test_a_worker_keeps_the_tables_of_one_operator():
    """The word table of the packing stage, up to hundreds of MB a worker, is gone once another operator uses the worker."""
    import gc
    import weakref

    from ratetally.llm import common, packing, words

    def alive(work) -> bool:
        table = weakref.ref(packing.encoder(WORD_BPE))
        assert table() is packing.encoder(WORD_BPE) and list(table().encode(["some words"]))
        work()
        gc.collect()
        return table() is not None

    assert not alive(lambda: words.hashes_of([b"a"]))
    assert not alive(common.forget)


def test_words_of_small_letters_and_marks_skip_the_text_steps_of_the_tokenizer():
    texts = [
        "Plain words, été’s naïve—no. (x) 'tis don't rock'n'roll's! a1b2. 3.14% ###", "É été ÉTÉ. straße; ÿ÷ø ×. Ã£,* µm ªº. x÷. 5×!? _a_ __ a_. a'. a's. A'S",
        "W̊ ẘ. Y̊ T̈ É é. É, Å KK.", "<|endoftext|> a<|ENDOFTEXT|>. <|x Ab", "a b. C \x1c\x85 ǅ. İ. ſ. ŉ.. ß.?", "", " \n ", "a" * 300 + ".",
    ]
    words = WordEncoder(WORD_BPE)
    whole, slow = words.tokenizer, []

    class Watched:
        def encode_batch_fast(self, some, **options):
            slow.extend(some)
            return whole.encode_batch_fast(some, **options)

    words.tokenizer = Watched()
    expected = [np.array(whole.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert list(words.encode(texts)) == expected
    slow.clear()
    list(words.encode(["Rates Of été. señor### straße,", "the\tonly new? Words $$$"]))
    assert set(slow) <= {".", ",", "?", "###", "$$$"}


def test_pipeline_sends_small_batches_to_python_unless_the_session_says_otherwise(spark):
    key = corpus_pipeline.BATCH_CONF
    docs = spark.range(3000).selectExpr("id AS doc_id", "repeat('many words ', 1000) AS text", "'en' AS lang", "'a' AS source", "11000L AS n_chars").coalesce(1)

    def sizes(batches):
        import pyarrow as pa

        yield pa.RecordBatch.from_arrays([pa.array([max(b.nbytes for b in batches)])], names=["most"])

    most = lambda: docs.mapInArrow(sizes, "most long").first()["most"]
    try:
        assert most() > 30_000_000
        for _, stage in corpus_pipeline.STAGES[-2:]:
            stage(spark, docs, SMALL)
        assert most() < 6_000_000
        spark.conf.set(key, "8m")
        corpus_pipeline.STAGES[-1][1](spark, docs, SMALL)
        assert spark.conf.get(key) == "8m"
    finally:
        spark.conf.unset(key)
