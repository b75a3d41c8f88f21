import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from quillspan.llm import decontaminate, exact_dedup, language, line_dedup, near_dedup, packing, registry, shared, token_counts, token_files, toxicity, warc
from quillspan.llm.tokens import encoder, vocabulary
from tests.oracle import SMALL, assert_same

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans(shared.UPPER, shared.LOWER)
LONG = " ".join(f"w{i}" for i in range(30_000))
ODD = [(1, "a b c d e f g", "x"), (1, "a b c d e f g", "x"), (2, None, None), (3, "", "y"), (None, "a b c d e f g", None), (4, LONG, "z"), (5, " \n\t ", "n"), (6, "É é Σας <|endoftext|> 12's", "k")]


@pytest.fixture(scope="module")
def docs(spark):
    shared.on_workers(spark)
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, and columns whose names the operators use."""
    shared.on_workers(spark)
    schema = "doc_id long, text string, lang string, source string, kept string, h string, n long, ids string, seg int, key string"
    return spark.createDataFrame([(i, t, x, x, "k", "h", 1, "i", 0, "key") for i, t, x in ODD], schema)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_same_rows_as_sql(spark, name):
    assert_same(spark, registry.QUERIES[name], registry.SQL[name])


def test_shuffled_decontamination(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", 0)
    assert_same(spark, decontaminate.op1_decontamination, decontaminate.OP1_SQL)


def test_short_items_and_case(spark):
    rows = [(1, "One two THREE four"), (2, "two, three"), (3, None), (3, None), (4, "É two three é")]
    bench = spark.createDataFrame([(10, "Two three"), (9, "two"), (11, ""), (None, "é")], "item_id long, text string")
    got = sorted((r.doc_id, r.n_words, r.n_hit, r.n_items) for r in decontaminate.contamination(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect())
    assert got == [(1, 4, 2, 2), (2, 2, 2, 2), (3, 0, 0, 0), (3, 0, 0, 0), (4, 4, 3, 2)]


def test_encoder_equals_the_library(docs):
    enc = encoder(vocabulary())
    for text in [r.text for r in docs.collect()] + [t for _, t, _ in ODD if t] + ["a\x85b\xa0c\x1cd", "x́ ﬁ Ⅷ ² 日本語", " I'M ''s it's!'s"]:
        assert enc.encode(text) == enc.plain(text)


def brute_classes(rows):
    bags = {}
    for i, t in rows:
        w = WORD.findall((t or "").translate(LOWER))
        bags[i] = Counter(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))) if w else Counter()
    root = {i: i for i in bags}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in bags:
        for b in bags:
            if a < b and bags[a] and bags[b]:
                same = sum((bags[a] & bags[b]).values())
                if same >= 0.8 * (sum(bags[a].values()) + sum(bags[b].values()) - same):
                    x, y = sorted((find(a), find(b)))
                    root[y] = x
    return {i: find(i) for i in bags}


@pytest.mark.parametrize("bucket", [2048, 3])
def test_near_classes_equal_brute_force(spark, docs, monkeypatch, bucket):
    monkeypatch.setattr(near_dedup, "BUCKET", bucket)
    got = {r.doc_id: r.class_id for r in near_dedup.near_classes(docs).collect()}
    assert got == brute_classes([(r.doc_id, r.text) for r in docs.collect()])


def test_bag_minhash_is_unbiased():
    rng = np.random.default_rng(1)
    x = rng.integers(1, 1 << 60, 300, np.int64).astype(np.uint64)
    a, b = rng.integers(1, 9, 300), rng.integers(1, 9, 300)
    agree = []
    for seed in range(20):
        s = near_dedup._mix(x + np.uint64(seed))
        sig = near_dedup.bag_minhash(np.r_[s, s], np.repeat([0, 1], 300), np.r_[a, b], 2)
        agree.append((sig[0] == sig[1]).mean())
    assert abs(np.mean(agree) - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.03


def test_token_files_round_trip(spark, docs, tmp_path):
    enc, start, want = encoder(vocabulary()), 0, []
    for r in sorted(docs.collect(), key=lambda r: r.doc_id):
        ids = enc.plain(r.text or "") + np.array([2], "<u4").tobytes()
        want.append((r.doc_id, start, len(ids) // 4, zlib.crc32(ids)))
        start += len(ids) // 4
    assert sorted(map(tuple, token_files.op3_token_files(spark, SMALL).collect())) == want
    token_files.write_tokens(docs, str(tmp_path / "t"), vocabulary())
    assert sorted(r.doc_id for r in token_files.read_tokens(spark, str(tmp_path / "t"), 5, 9).collect()) == [5, 6, 7, 8, 9]


@pytest.mark.parametrize("which", ["docs", "odd"])
def test_packing_holds_every_id_once(request, which):
    df = request.getfixturevalue(which)
    enc, rows = encoder(vocabulary()), packing.pack(df, vocabulary()).collect()
    want = Counter((r.doc_id, len(enc.plain(r.text or "")) // 4 + 1) for r in df.collect())
    assert Counter() + Counter({k: n * k[1] for k, n in want.items()}) == sum((Counter({(r.doc_id, r.doc_tokens): r.length}) for r in rows), Counter())
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for pieces in bins.values():
        total = 0
        for offset, length in sorted(pieces):
            assert offset == total
            total += length
        assert total == 2048 or total & (total - 1) == 0 and total < 2048


def test_archives(spark, tmp_path):
    html = "<p>" + "x" * 200
    rows = [(7, "http://a/", html), (3, "http://b c/", html), (11, "u", html), (1, "u", "short"), (2, "u", "short"), (None, None, None)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = {r.page_id: (r.record_type, r.refers_to, r.payload_bytes) for r in warc.op5_warc(spark, str(tmp_path)).collect()}
    assert got == {3: ("response", None, 203), 7: ("revisit", 3, 203), 11: ("revisit", 3, 203), 1: ("response", None, 5), 2: ("response", None, 5), None: ("response", None, 0)}


def test_arc_errors():
    with pytest.raises(ValueError):
        list(warc.arc_records(b"filedesc://x 0 0 text/plain 4\n9 0 \n"))
    block = b"1 0 x\nURL IP-address Archive-date Content-type Archive-length\n"
    with pytest.raises(ValueError):
        list(warc.arc_records(b"filedesc://x 0.0.0.0 2024 text/plain %d\n" % len(block) + block + b"u 1.1.1.1 2024 text/html 50\nshort"))


def test_toxic_documents_are_found(spark):
    train = [(i, f"calm words number {i} here " + ("vileword again" if i % 4 == 0 else "fair enough")) for i in range(400)]
    docs = spark.createDataFrame(train, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i, _ in train], "doc_id long, toxic int")
    got = toxicity.scores(docs, toxicity.train(docs, labels)).where("held_out").collect()
    assert got and all(r.predicted == int(r.doc_id % 4 == 0) for r in got)
    assert toxicity.scores(docs, toxicity.train(docs, labels.where("toxic > 5"))).where("score < 0 OR score > 1").isEmpty()


def test_languages_of_the_held_out_fold(spark, docs):
    got = language.op8_language(spark, SMALL).where("held_out").join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert sum(r.lang_pred == r.lang for r in got) >= 0.9 * len(got)


def test_suffix_automaton():
    a = language.SuffixAutomaton("abcbc")
    assert [a.phrases(s) for s in ("abcbc", "bcb", "ca", "xx", "")] == [1, 1, 2, 2, 0]


def test_rollup_by_deltas(spark, tmp_path):
    r = token_counts.Rollup(spark, str(tmp_path / "r"))
    change = lambda *rows: spark.createDataFrame(rows, "op string, doc_id long, source string, lang string, tokenizer string, n_tokens long")
    assert r.commit("b1", change(("insert", 1, "s", "en", "v1", 10), ("insert", 2, "s", None, "v1", 5)))
    again = change(("revise", 1, "t", "en", "v1", 7), ("delete", 2, None, None, "v1", None), ("insert", 3, "s", "en", "v2", 2))
    assert r.commit("b2", again) and not r.commit("b2", again)
    assert sorted(map(tuple, r.totals().collect())) == [("s", "en", "v2", 1, 2), ("t", "en", "v1", 1, 7)]
    with pytest.raises(Exception, match="unknown op"):
        r.commit("b3", change(("upsert", 1, "s", "en", "v1", 1)))
    assert set(r.committed()) == {"b1", "b2"}


def test_lines_equal_brute_force(spark):
    base = ["the quick brown fox jumps over", "the quick brown fox jumps ever", "the quick brown fox jump over", "another line of some length here", "tiny"]
    rows = [(1, "\n".join(base[:1])), (2, "\n".join(base)), (3, base[2] + "\n" + base[3] + "\ntiny"), (4, None), (5, ""), (None, base[0])]
    got = {r.doc_id: (r.dropped, r.text) for r in line_dedup.clean_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {k: v[0] for k, v in got.items()} == {1: [], 2: [0, 1, 2], 3: [0, 1, 2], 4: [], 5: [], None: []}
    assert got[2][1] == base[3] + "\ntiny" and got[4][1] is None


def test_odd_rows(spark, odd):
    n = len(ODD)
    for df in (exact_dedup.exact_groups(odd), near_dedup.near_classes(odd), language.identify(odd, {"en": "a b"}), line_dedup.clean_lines(odd), toxicity.scores(odd, {"buckets": [], "weights": [], "bias": 0.0}), token_counts.token_counts(odd, vocabulary())):
        assert df.count() == n
    bench = spark.createDataFrame([(1, "w1 w2 w3")], "item_id long, text string")
    assert decontaminate.contamination(odd, bench).count() == n
    assert exact_dedup.drop_exact(odd).count() == 4
    for df in (exact_dedup.exact_groups(odd.limit(0)), near_dedup.near_classes(odd.limit(0)), packing.pieces(odd.limit(0)), line_dedup.clean_lines(odd.limit(0)), decontaminate.contamination(odd.limit(0), bench)):
        assert df.count() == 0


def test_pipeline_columns(spark):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact dedup", "near dedup", "decontamination", "packing"]
    assert corpus_pipeline.run(spark, SMALL).count() > 0


@pytest.mark.parametrize("rows", [0, 200_000])
def test_lines_at_one_edit_anywhere(spark, monkeypatch, rows):
    """Edits at every place of lines with runs of equal characters, by broadcast and by shuffled joins."""
    monkeypatch.setattr(line_dedup, "BROADCAST_ROWS", rows)
    rng, lines = random.Random(5), []
    for n in (20, 21, 22, 27):
        base = "".join(rng.choice("aab") for _ in range(n))
        lines.append(base)
        for i in range(n + 1):
            lines.append(rng.choice([base[:i] + "b" + base[i + 1 :], base[:i] + "a" + base[i:], base[:i] + base[i + 1 :], base[:i] + "zz" + base[i:]]))
    rng.shuffle(lines)
    lines = [x for x in lines if len(x) >= 20]

    def near(a, b):
        if len(a) > len(b):
            a, b = b, a
        if len(b) - len(a) > 1:
            return False
        i = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
        return a[i:] == b[i + 1 :] or a[i + 1 :] == b[i + 1 :]

    want = {i for i, x in enumerate(lines) if any(near(x, y) for y in lines[:i])}
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    got = {r.doc_id: r.keep_doc_id for r in line_dedup.dropped_lines(docs).collect()}
    assert set(got) == want
    assert all(k < i and near(lines[k], lines[i]) for i, k in got.items())


def test_near_copies_that_share_only_boilerplate(spark, monkeypatch):
    """Texts of 200 common shingles: those with 40 own are similar to none, the two with 20 own to each other.

    The hashes of the two ids differ by a number without a factor below 260, so no block of a bucket holds both.
    """
    monkeypatch.setattr(near_dedup, "BUCKET", 4)
    head, two = " ".join(f"b{i}" for i in range(204)), (10000, 10002)
    rows = [(i, f"{head} " + " ".join(f"o{i}x{j}" for j in range(20 if i in two else 40))) for i in (*range(1000), *two)]
    got = {r.doc_id: r.class_id for r in near_dedup.near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: two[0] if i in two else i for i, _ in rows}


def test_short_lines_go(spark, tmp_path):
    """Short lines go if equal ones or ones at one edit stand earlier, those of one character too; empty lines stay."""
    rows = [(1, "Read more\n\nx"), (2, " Read more\n\nRead mare\nx"), (3, "Read more\t\n  \nRead more\ny")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: (r.n_lines, r.dropped) for r in line_dedup.op10_line_dedup(spark, str(tmp_path)).collect()}
    assert got == {1: (3, []), 2: (4, [0, 2, 3]), 3: (4, [0, 2, 3])}
