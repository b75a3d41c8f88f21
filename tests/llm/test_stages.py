"""Stages and operators against plain versions: rows that share ids, whole pipelines, files, phrases, scores and totals."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from quillspan.llm import decontaminate, exact_dedup, language, line_dedup, near_dedup, packing, shared, token_counts, token_files, toxicity, warc
from quillspan.llm.shared import table
from quillspan.llm.tokens import encoder, vocabulary
from tests.llm.test_llm import LOWER, WORD, brute_classes
from tests.oracle import SMALL

A, B, C = "one two three four five six seven", "another text of seven other plain words", "w x y z a b c d e f g"


def frame(spark, rows):
    shared.on_workers(spark)
    return spark.createDataFrame(rows, "doc_id long, text string, h string, rows int")


def got(df):
    return Counter((r.doc_id, r.text) for r in df.collect())


ROWS = [(3, A, "x", 1), (5, A, "y", 2), (5, B, "z", 3), (5, B, "z", 4), (7, C, None, 5), (8, None, None, 6), (9, None, None, 7), (10, "", None, 8), (None, B, "n", 9)]


def test_rows_that_share_an_id(spark):
    """Of each class one row stays; rows of one id and other texts are told apart, whole repeats stay once, and other columns stay."""
    df = frame(spark, ROWS)
    assert got(near_dedup.drop_near(df)) == Counter([(3, A), (5, B), (7, C), (8, None), (9, None), (10, ""), (None, B)])
    kept = exact_dedup.drop_exact(df)
    assert got(kept) == Counter([(3, A), (5, B), (7, C), (8, None)]) and kept.columns == df.columns
    bench = spark.createDataFrame([(1, A)], "item_id long, text string")
    assert got(decontaminate.drop_contaminated(df, bench)) == Counter({(r[0], r[1]): sum(x[:2] == r[:2] for x in ROWS) for r in ROWS if r[1] != A})


def test_toxic_rows_go_on_their_own(spark):
    train = [(i, f"calm words number {i} here " + ("vileword again" if i % 4 == 0 else "fair enough"), None, i) for i in range(400)]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i, *_ in train], "doc_id long, toxic int")
    both = [(i, f"new {i} " + t, "h", 0) for i in (1, 4) for t in ("vileword again", "fair enough")]
    out = toxicity.drop_toxic(frame(spark, train + both), labels)
    assert got(out) == Counter((i, t) for i, t, *_ in train + both if "vileword" not in t) and out.columns == ["doc_id", "text", "h", "rows"]


def grams(text):
    t = f" {text.lower()} "
    return {t[i : i + n] for n in (3, 4, 5) for i in range(len(t) - n + 1)}


def test_scores_equal_a_loop(spark):
    """Scores of a fitted model are those of a loop over sets of n-grams; a text longer than a slice scores like one in a piece."""
    docs, labels = table(spark, SMALL, "documents"), table(spark, SMALL, "labels")
    model = toxicity.train(docs, labels)
    weight = dict(zip(model["buckets"], model["weights"]))
    assert len(weight) > 10
    bucket = {}
    rows = [(r.doc_id, r.text) for r in docs.orderBy("doc_id").limit(30).collect()] + [(-1, None), (-2, "")]
    rows.append((-3, " ".join(t for _, t in rows if t) * (toxicity.CHUNK // 20_000)))
    for _, t in rows:
        for n in (3, 4, 5):
            for g in grams(t or ""):
                if len(g) == n and g not in bucket:
                    bucket[g] = next(int(b[0]) for b, _ in list(toxicity._grams([g]))[-1:])
    for r in toxicity.scores(frame(spark, [(*x, None, 0) for x in rows]), model).collect():
        text = dict(rows)[r.doc_id] or ""
        z = sum(weight.get(b, 0) for b in {bucket[g] for g in grams(text)}) + model["bias"]
        assert math.isclose(r.score, 1 / (1 + math.exp(-max(-30, min(30, z)))), rel_tol=1e-9)


def test_toxicity_on_the_held_out_fold(spark):
    d = "/root/testdata/sf0.1"
    rows = toxicity.op6_toxicity(spark, d).where("held_out").join(table(spark, d, "labels").where("toxic IS NOT NULL"), "doc_id").select("predicted", "toxic").collect()
    toxic = [r.predicted for r in rows if r.toxic]
    assert sum(toxic) >= 0.75 * len(toxic) and sum(r.predicted for r in rows if not r.toxic) <= 0.02 * len(rows)


def test_phrases_equal_all_substrings():
    texts = ["abracadabra banana", "the cat sat on the mat and that was that", "aaaa"]
    for base in texts:
        automaton, subs = language.SuffixAutomaton(base), {base[i:j] for i in range(len(base)) for j in range(i + 1, len(base) + 1)}
        for text in (*texts, "xyz", "bananabra", "that cat, that mat", ""):
            n = at = 0
            while at < len(text):
                end = at + 1
                while end < len(text) and text[at : end + 1] in subs:
                    end += 1
                n, at = n + 1, end
            assert automaton.phrases(text) == n


def test_predictions_take_the_fewest_phrases(spark):
    parser = language.Parser({"aa": "ba da ga na ka", "bb": "bo do go no ko"})
    assert [parser.predict(t)[0] for t in ("Da-Ga", "do go, no!", None, "", "²", "½ 3", "①")] == ["aa", "bb", "und", "und", "und", "und", "und"]
    assert parser.predict("xx")[1] == 0.5
    df = spark.createDataFrame([(1, "bo do", "bb", "x"), (1, "bo do", "bb", "y"), (2, None, "aa", None), (3, "go no ko", "bb", "k"), (None, "ba", "aa", "n")], "doc_id long, text string, lang string, key string")
    out = sorted(((r.doc_id, r.lang_pred) for r in language.identify(df, {"aa": "ba da", "bb": "bo do"}).collect()), key=repr)
    assert out == [(1, "bb"), (1, "bb"), (2, "und"), (3, "bb"), (None, "aa")]
    assert set(language.training_texts(df, 100)) <= {"aa", "bb"} and language.identify(df.limit(0), {}).isEmpty()


@pytest.mark.parametrize("capacity", [2048, 64])
def test_packed_ids_equal_the_documents(spark, capacity):
    docs = table(spark, SMALL, "documents").select("doc_id", "text").unionByName(spark.createDataFrame([(-1, None), (-2, ""), (-3, "same"), (-3, "same")], "doc_id long, text string"))
    enc, end = encoder(vocabulary()), b"\1\0\0\0"
    pieces = defaultdict(list)
    for r in packing.pack(docs, vocabulary(), capacity=capacity).withColumn("crc", F.crc32("ids")).collect():
        assert len(r.ids) == 4 * r.length and r.crc == zlib.crc32(r.ids)
        pieces[r.doc_id, r.doc_tokens].append((r.start, bytes(r.ids)))
    for r in docs.distinct().collect():
        ids = enc.plain(r.text or "") + end
        parts = sorted(pieces.pop((r.doc_id, len(ids) // 4)))
        assert b"".join(b for _, b in parts) == ids * (2 if r.doc_id == -3 else 1) or r.doc_id == -3
        assert sum(len(b) for _, b in parts) == len(ids) * (2 if r.doc_id == -3 else 1)
    assert not pieces


def test_token_files_hold_pages_and_indexes(spark, tmp_path):
    docs = frame(spark, [(i % 50, f"text {i} " * (i % 7), None, 0) for i in range(2000)] + [(None, "null id", None, 0), (3, None, None, 0)])
    token_files.write_tokens(docs, str(tmp_path / "t"), vocabulary())
    found, n = set(), 0
    for f in sorted((tmp_path / "t").glob("part-*.parquet")):
        meta = pq.ParquetFile(f).metadata
        n += meta.num_rows
        for g in range(meta.num_row_groups):
            for c in range(meta.num_columns):
                column = meta.row_group(g).column(c)
                assert column.has_offset_index and column.has_column_index
                found |= set(column.encodings)
    assert n == docs.count() and "RLE_DICTIONARY" in found
    plan = token_files.read_tokens(spark, str(tmp_path / "t"), 5, 9)._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(doc_id,5)" in plan and "LessThanOrEqual(doc_id,9)" in plan
    numbers = token_files.read_numbers(spark, str(tmp_path / "t"))
    assert "ids" not in re.findall(r"ReadSchema: (.*)", numbers._jdf.queryExecution().toString())[0]
    rows = sorted(((r.start, r.n_tokens, r.doc_id) for r in numbers.collect()))
    assert all(a[0] + a[1] == b[0] for a, b in zip(rows, rows[1:])) and [r[2] for r in rows] == sorted((r[2] for r in rows), key=lambda i: (i is not None, i))
    token_files.write_tokens(docs.limit(0), str(tmp_path / "e"), vocabulary())
    assert token_files.read_numbers(spark, str(tmp_path / "e")).isEmpty()


def test_token_totals_equal_a_count(spark):
    enc, want = encoder(vocabulary()), defaultdict(lambda: [0, 0])
    for r in table(spark, SMALL, "documents").collect():
        n = len(enc.plain(r.text or "")) // 4
        for level, key in (("source-lang", (r.source, r.lang)), ("source", (r.source, None)), ("lang", (None, r.lang)), ("all", (None, None))):
            want[level, *key][0] += 1
            want[level, *key][1] += n
    out = {(r.level, r.source, r.lang): [r.n_docs, r.n_tokens] for r in token_counts.op9_token_counts(spark, SMALL).where("tokenizer = 'word_bpe_49k/1'").collect()}
    assert out == dict(want)


def test_chains_of_near_lines(spark):
    """c is one edit from b, b one from a: both go, each names the line near it, and both end at a."""
    a = "a line of some twenty characters"
    b, c = a.replace("some", "same"), a.replace("some", "same").replace("line", "lime")
    rows = line_dedup.dropped_lines(frame(spark, [(1, a, None, 0), (2, b, None, 0), (3, c + "\n" + c, None, 0)])).collect()
    assert {(r.doc_id, r.line_no): (r.keep_doc_id, r.end_doc_id, r.end_line_no) for r in rows} == {(2, 0): (1, 1, 0), (3, 0): (2, 1, 0), (3, 1): (2, 1, 0)}


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    a, b = sorted((a, b), key=len)
    i = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
    return a[i + (len(a) == len(b)) :] == b[i + 1 :] or a == b


def test_short_lines_equal_brute_force(spark):
    """Lines of one character and more, with repeats, against all earlier ones; with a bound, shorter ones go for equal ones only."""
    rng = random.Random(9)
    lines = ["short line here", "short line hero", "a", "", "b", "é", "1.", "12."] + ["".join(rng.choice("abc ") for _ in range(rng.randint(1, 12))) for _ in range(150)]
    docs = frame(spark, [(i, x, None, 0) for i, x in enumerate(lines)])
    bare = [x.strip(" ") for x in lines]
    for edited in (1, 5):
        fit = lambda x, y: x == y or min(len(x), len(y)) >= edited and one_edit(x, y)
        want = {i for i, x in enumerate(bare) if x and any(y and fit(x, y) for y in bare[:i])}
        got = {r.doc_id: r.keep_doc_id for r in line_dedup.dropped_lines(docs, 1, edited).collect()}
        assert set(got) == want and all(fit(bare[k], bare[i]) for i, k in got.items())
    assert 1 in line_dedup.dropped_lines(docs).select("doc_id").toPandas()["doc_id"].tolist()


def test_lines_of_documents_equal_brute_force(spark):
    """The whole query on the smallest table against a search by wild cards over all earlier lines."""
    rows = table(spark, SMALL, "documents").select("doc_id", "text").collect()
    lines = sorted((r.doc_id, n, x.strip(" \t\r")) for r in rows for n, x in enumerate((r.text or "").split("\n")))
    seen, gone = set(), defaultdict(list)
    for doc, n, x in lines:
        if not x:
            continue
        keys = {("=", x)} | {("*", x[:i] + "\0" + x[i + 1 :]) for i in range(len(x))} | {("-", x[:i] + x[i + 1 :]) for i in range(len(x))}
        if ("=", x) in seen or any(("*", x[:i] + "\0" + x[i + 1 :]) in seen for i in range(len(x))) or ("-", x) in seen or any(("=", x[:i] + x[i + 1 :]) in seen for i in range(len(x))):
            gone[doc].append(n)
        seen |= keys
    assert {r.doc_id: r.dropped for r in line_dedup.op10_line_dedup(spark, SMALL).collect() if r.dropped} == dict(gone)


#: Names that steps of the operators use.
INNER = ["__t", "__maybe", "__key", "__seg", "__bits", "__k0", "__k1", "__id", "__h", "__g0", "h", "k", "k1", "u", "n", "seg", "row", "t", "rows", "stays", "copies", "b", "v"]


def test_stages_with_any_column_names(spark):
    """Columns with the names of all helpers stay as they are, with nulls, repeats and rows that share an id."""
    texts = [(3, A), (5, A), (5, B), (5, B), (7, C), (8, None), (8, None), (None, B), (9, A + " eight nine ten eleven twelve thirteen fourteen")]
    schema = "doc_id long, text string, " + ", ".join(f"`{c}` string" for c in INNER)
    shared.on_workers(spark)
    df = spark.createDataFrame([(i, t, *[f"{c}{n}" if n % 2 else None for c in INNER]) for n, (i, t) in enumerate(texts)], schema)
    bench, labels = spark.createDataFrame([(1, C)], "item_id long, text string"), spark.createDataFrame([(3, 0)], "doc_id long, toxic int")
    whole = Counter(map(tuple, df.collect()))
    for out, n in ((exact_dedup.drop_exact(df), 5), (near_dedup.drop_near(df), 7), (decontaminate.drop_contaminated(df, bench), 8), (toxicity.drop_toxic(df, labels), 9)):
        rows = Counter(map(tuple, out.collect()))
        assert out.columns == df.columns and sum(rows.values()) == n and not rows - whole
        assert out.limit(0).columns == df.columns


def test_lines_by_both_joins(spark, monkeypatch):
    docs = table(spark, SMALL, "documents")
    plain = sorted(map(tuple, line_dedup.clean_lines(docs).select("doc_id", "text", "n_lines", "dropped").collect()))
    monkeypatch.setattr(line_dedup, "BROADCAST_BYTES", -1)
    assert sorted(map(tuple, line_dedup.clean_lines(docs).select("doc_id", "text", "n_lines", "dropped").collect())) == plain


def test_filters_in_shards(spark, monkeypatch):
    docs = table(spark, SMALL, "documents")
    rows = lambda: sorted(map(tuple, exact_dedup.exact_groups(docs).collect()))
    plain = rows()
    monkeypatch.setattr(exact_dedup, "BROADCAST_SEGMENTS", 0)
    assert rows() == plain


def test_pipeline_equals_plain_versions(spark):
    """Each stage's rows on its own input: scores, equal texts, classes, SQL of the contamination rule, and packed tokens."""
    import corpus_pipeline

    docs = table(spark, SMALL, "documents")
    for name, stage in corpus_pipeline.STAGES:
        before = [(r.doc_id, r.text) for r in docs.collect()]
        out = shared.stored(stage(spark, docs, SMALL), "stage")
        if name == "packing":
            enc = encoder(vocabulary())
            sums = Counter()
            for r in out.collect():
                sums[r.doc_id, r.doc_tokens] += r.length
            assert sums == {(i, n): n for i, n in ((i, len(enc.plain(t or "")) // 4 + 1) for i, t in before)}
            break
        assert out.columns == docs.columns
        if name == "toxicity":
            model = toxicity.train(docs, table(spark, SMALL, "labels"))
            want = {r.doc_id for r in toxicity.scores(docs, model).where("predicted = 0").collect()}
        elif name == "exact dedup":
            groups = defaultdict(list)
            for i, t in before:
                groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i))
            want = {min(g)[1] for g in groups.values()}
        elif name == "near dedup":
            want = set(brute_classes(before).values())
        else:
            con = duckdb.connect()
            docs.toPandas().pipe(lambda df: con.register("documents", df))
            con.sql(f"create view benchmark as select * from '{SMALL}/benchmark.parquet'")
            want = {i for i, dirty in con.sql(f"select doc_id, contaminated from ({decontaminate.OP1_SQL})").fetchall() if not dirty}
        assert sorted(r.doc_id for r in out.collect()) == sorted(want), name
        docs = out
    assert len(WORD.findall("A b".translate(LOWER))) == 2


def test_stages_of_nothing(spark):
    import corpus_pipeline

    docs = table(spark, SMALL, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert shared.stored(stage(spark, docs, SMALL), "none").isEmpty()


def test_other_id_types(spark):
    """Ids of any type, here decimals, pass all operators."""
    docs = frame(spark, ROWS[:5]).withColumn("doc_id", F.col("doc_id").cast("decimal(20,0)"))
    assert near_dedup.near_classes(docs).count() == exact_dedup.exact_groups(docs).count() == line_dedup.clean_lines(docs).count() == 5
    assert token_counts.token_counts(docs.withColumns({"source": F.lit("s"), "lang": F.lit("l")}), vocabulary()).count() == 5
    assert packing.pieces(docs).select(F.sum("length")).first()[0] > 5 and len(toxicity.scores(docs, {"buckets": [], "weights": [], "bias": 0.0}).collect()) == 5
    assert warc.FIELDS["1"][0] == "URL"


def test_archives_of_both_versions(spark, tmp_path):
    """Offsets lead to members, files split by records, dates of all lengths, resources, and what revisits refer to."""
    import gzip

    pages = spark.createDataFrame([(i, f"http://a/{i}", "<p>" + "x" * (100 + i % 3), "k", 1) for i in range(12)], "page_id long, url string, html string, key string, size int")
    warc.write_arc(pages.repartition(1), str(tmp_path / "v1"), 4)
    first = b"2 0 x\n" + " ".join(warc.FIELDS["2"]).encode() + b"\n"
    head = b"filedesc://o.arc 0.0.0.0 20200203 text/plain 200 - - 0 o.arc %d\n" % len(first) + first + b"\n"
    rows = [(b"dns:a 1.1.1.1 202401011234 text/dns 200 - - 0 o.arc 3\nabc\n"), (b"http://b 1.1.1.1 junk text/html 200 - - 0 o.arc %d\n" % (19 + 103)) + b"HTTP/1.1 200 OK\r\n\r\n" + b"<p>" + b"x" * 100 + b"\n"]
    (tmp_path / "v1" / "o.arc.gz").write_bytes(gzip.compress(head) + b"".join(map(gzip.compress, rows)))
    warc.convert(spark, str(tmp_path / "v1"), str(tmp_path / "w"), 4)
    records = [r for f in sorted((tmp_path / "w").glob("*.warc.gz")) for r in warc.warc_records(f.read_bytes())]
    assert len(list((tmp_path / "v1").glob("part-*.arc.gz"))) == 4
    kinds = Counter(h["warc-type"] for h, _ in records)
    assert kinds["resource"] == 1 and kinds["response"] == 3 and kinds["revisit"] == 10 and kinds["warcinfo"] >= 4
    dates = {h["warc-target-uri"]: h["warc-date"] for h, _ in records if "warc-target-uri" in h}
    assert dates["dns:a"] == "2024-01-01T12:34:00Z" and dates["http://b"] == "2020-02-03T00:00:00Z"
    for h, _ in records:
        if h["warc-type"] == "revisit":
            assert h["warc-refers-to-target-uri"] in dates and h["warc-refers-to-date"] == dates[h["warc-refers-to-target-uri"]]
    f = sorted((tmp_path / "w").glob("part-*.warc.gz"))[0].read_bytes()
    assert len(re.findall(rb"\x1f\x8b\x08", f)) >= 2 and gzip.decompress(f).startswith(b"WARC/1.0")
    warc.write_arc(pages.repartition(2), str(tmp_path / "v2"))
    for f in (tmp_path / "v2").glob("part-00001*.arc.gz"):
        raw = f.read_bytes()
        for h, content in warc.arc_records(raw):
            if "Offset" in h:
                assert gzip.decompress(raw[int(h["Offset"]) :]).startswith(h["URL"].encode() + b" ") and content.startswith(b"HTTP/")


def test_the_first_of_racing_writers_counts(spark, tmp_path):
    r, other = (token_counts.Rollup(spark, str(tmp_path / "r")) for _ in range(2))
    change = spark.createDataFrame([("insert", 1, "s", "en", "v1", 10)], "op string, doc_id long, source string, lang string, tokenizer string, n_tokens long")
    assert other.committed() == {} and r.commit("b", change)
    before = r.committed()["b"]
    assert not other._mark("b", "a-smaller-name") and other.committed() == {"b": before} == token_counts.Rollup(spark, r.path).committed()
    with pytest.raises(ValueError):
        r.commit("a/b", change)
