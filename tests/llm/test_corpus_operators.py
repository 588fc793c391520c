"""Corpus operators against brute force, a public library or held-out labels."""

import collections
import hashlib
import re
import sys
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gleaner.llm import exact, ga2m, langid, lexicon, maintext, minmax, packing, rules, suffix, warc
from gleaner.llm.util import components
from gleaner.llm.wordbpe import WordBpe, compile_tables, vocabulary_text

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, keep_id long, key long, file string"

PASSAGE = "common passage of words that several documents share and which is surely longer than two hundred bytes " * 3
WORDS = [f"word{i}x" for i in range(400)]


def corpus():
    rng = np.random.default_rng(3)

    def text(n):
        return " ".join(rng.choice(WORDS, n))

    base = text(120)
    near = base.split()
    near[7] = "changed"
    texts = [None, "", " ", "one", "one", "One two", "a" * 1500, "ab" * 700, base, base, base.replace(" ", "\n"),
             " ".join(near), text(30) + PASSAGE + text(30), PASSAGE + text(40), text(40) + PASSAGE,
             text(5000), "é" * 300 + text(20), "x<|endoftext|>y  z \n w ", "THE and of, la de. der"]
    return [(i if i != 9 else 8, t, "en", "s", None if t is None else len(t), 1, 2, "f") for i, t in enumerate(texts)] + [
        (None, "null id text here", None, None, None, None, None, None), (12, texts[12], "fr", None, 0, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs"))
    spark.createDataFrame(corpus(), DOCS).repartition(3).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("empty"))
    spark.createDataFrame([], DOCS).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def rows_of(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


# --- 1 ------------------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var a="</p>";</script></head><body>
<nav><ul><li><a href="/x">Menu one</a></li></ul></nav><!-- c --><div class="ad">Buy this</div>
<article><h1>The   title of it &amp; more</h1><p><b>First words of a long paragraph&nbsp;here<br><p>Second part with &lt;tags&gt; and
lines of text.</p><aside>not this</aside><p>Third one &#233; ends the text of the page</article>
<div class="comments"><p>I was here first</p></div><footer>&copy; me</footer></body></html>"""


def variants():
    """Markup that says the same in other words: what it does to a page, what text it adds."""
    def around(x, opens, closes):
        return x.replace("<body>", "<body>" + opens).replace("</body>", closes + "</body>")

    return {
        "body": (lambda x: x.replace("<body", '<body class="has-sidebar"'), ""),
        "article": (lambda x: x.replace("<article", '<article class="post share"'), ""),
        "heading": (lambda x: x.replace("<h1", '<h1 class="related"'), ""),
        "wrapper": (lambda x: around(x, '<div class="page sidebar-right nav-open">', "</div>"), ""),
        "form": (lambda x: around(x, '<form id="all">', "</form>"), ""),
        "comments within": (lambda x: x.replace("</article>", '<div class="comments"><p>I was here and say many words</p></div>'
                                                              "<p>last short one.</p></article>"), "\nlast short one."),
        "long comments": (lambda x: x.replace("</article>", '</article><div class="comments"><article class="comment"><p>'
                                              + "reader words " * 5000 + "</p></article></div>"), ""),
    }


@pytest.mark.parametrize("name", list(variants()))
def test_marks_on_wrappers_and_parts(name):
    """Over all pages: the text stays the same, by weights of the plain pages and by those of the varied ones."""
    import pyarrow.parquet as pq

    pages = pq.read_table(f"{SF}/pages.parquet").column("html").to_pylist()
    change, more = variants()[name]
    plain = maintext.weights_of(maintext.count_features(pages))
    varied = maintext.weights_of(maintext.count_features([change(x) for x in pages]))
    for x in pages:
        want = maintext.extract(x, plain)
        assert want and maintext.extract(change(x), plain) == maintext.extract(change(x), varied) == want + more


def test_main_text_of_all_pages(spark):
    """Against a cut by regular expressions: the article without adverts, block by block."""
    import html

    rows = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r["page_id"]: r["text"] for r in maintext.main_text(rows, maintext.learn(rows)).collect()}
    for r in rows.collect():
        inside = re.search(r"(?s)<article>(.*)</article>", r["html"])[1]
        inside = re.sub(r'(?s)<!--.*?-->|<(script|style|nav|aside|form|footer)\b.*?</\1>|<div class="(ad|comments)">.*?</div>', "\n<p>", inside)
        blocks = re.split(r"</?(?:p|h\d|div|ul|ol|li|br|pre|blockquote|table|tr|td|section|figure)\b[^>]*>", inside)
        want = [re.sub(r"[ \t\n\r\f\v\xa0]+", " ", html.unescape(re.sub(r"<[^>]*>", "", b))).strip(" ") for b in blocks]
        assert got[r["page_id"]] == "\n".join(b for b in want if b), r["page_id"]


def test_learnt_class_words():
    """A word that isn't on the list marks an element if it stands outside the articles."""
    page = ("<body><div class='zone7'><p>" + "stuff in a box " * 30 + "</p></div><article><h1>Head</h1><div class='zone8'><p>"
            + "the text of it " * 20 + "</p></div></article><footer>x</footer></body>")
    weights = maintext.weights_of(maintext.count_features([page] * 10))
    assert weights["c:zone7"] < maintext.OUTSIDE and "c:zone8" not in weights
    bare = page.replace("<article>", "<div>").replace("</article>", "</div>")
    assert maintext.extract(bare, weights).startswith("Head\nthe text of it")


def test_main_text_of_a_page_and_odd_pages(spark):
    weights = maintext.weights_of(maintext.count_features([PAGE]))
    want = ("The title of it & more\nFirst words of a long paragraph here\n"
            "Second part with <tags> and lines of text.\nThird one é ends the text of the page")
    assert maintext.extract(PAGE, weights) == want
    assert maintext.extract(PAGE, {}).startswith(want[:60])         # by prior weights alone
    assert maintext.extract(None, weights) == maintext.extract("", weights) == ""
    assert maintext.extract("<p>cut <a href='", weights).startswith("cut")
    assert len(maintext.extract("<p>" + "word " * 50_000, weights).split()) == 50_000
    pages = spark.createDataFrame([(1, "u", PAGE, "x"), (1, "u", PAGE, "x"), (2, None, None, "x")],
                                  "page_id long, url string, html string, text string")
    got = rows_of(maintext.main_text(pages, maintext.learn(pages)), "page_id", "text", "n_chars")
    assert got == [(1, want, len(want)), (1, want, len(want)), (2, "", 0)]
    assert maintext.main_text(pages.limit(0), maintext.learn(pages.limit(0))).count() == 0


@pytest.mark.parametrize("tag", [
    '<p class="a"">', '<p class=""a">', "<p title=it's>", "<p title='it's'>", '<p title=5">', '<p ">', "<p a'b>", '<p"x>',
    '<p title="a" "b>', '<p ="x>', '<p a=="x>', '<p title= >', "<p title='a>", '<p title=\xa0"a>', '<p title="a>b">', "<p title = 'a>b\"'>",
    '<p title="a"id=\'>\'>', "<p/title='>'/>"])
def test_a_tag_ends_where_html_ends_it(tag):
    page = f'{tag}First words</p><p>Second words</p> the "end"' + (" of it" if tag.count("'") == 1 else "")
    assert maintext.extract(page, {}).split() == page.replace(tag, "").replace("</p>", " ").replace("<p>", " ").split()
    kept = [t for t in maintext.tokens(page) if t[0] == "open"]
    assert kept[-1][:2] == ("open", "p") and not kept[-1][2] and not kept[-1][3] and len(kept) == 2


def test_best_region_is_the_maximum_subsequence():
    rng = np.random.default_rng(1)
    for _ in range(200):
        s = rng.integers(-5, 6, rng.integers(1, 25)).tolist()
        a, b = maintext.best_region(s)
        assert sum(s[a:b]) == max(0, max(sum(s[i:j]) for i in range(len(s)) for j in range(i + 1, len(s) + 1)))


# --- 2 ------------------------------------------------------------------------------

def test_quality_on_held_out_labels(spark):
    got = ga2m.op2_quality_gam(spark, "/root/testdata/sf0.01")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    held = got.where("held_out").join(labels, "doc_id").collect()
    assert np.mean([r["predicted"] == r["quality"] for r in held]) >= 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in held)


def test_quality_odd_inputs(docs, empty, spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(15)] + [(16, None)], "doc_id long, quality int")
    model = ga2m.train(docs, labels)
    assert ga2m.quality(docs, model).count() == len(corpus())
    assert ga2m.quality(empty, model).count() == 0
    none = ga2m.train(empty, labels)
    assert {r["score"] for r in ga2m.quality(docs, none).collect()} == {0.5}


# --- 3 ------------------------------------------------------------------------------

def test_warc_round_trip(spark, tmp_path):
    long = "x\r\n\r\n" * 60
    pages = spark.createDataFrame([(3, "u3", long, 1), (1, 'u"1\n', long, 1), (2, None, None, 1), (5, "a", "short", 1),
                                   (6, "a", "short", 1), (None, "n", long, 1), (1, 'u"1\n', long, 1)],
                                  "page_id long, url string, html string, digest int")
    index, folder = warc.archive(pages)
    got = rows_of(warc.read_records(index, folder), "page_id", "payload_bytes", "record_type", "refers_to", "url", "intact")
    n = len(long)
    assert got == sorted([(1, n, "response", None, 'u"1\n', True)] * 2 + [
        (2, 0, "response", None, "", True), (3, n, "revisit", 1, "u3", True), (5, 5, "response", None, "a", True),
        (6, 5, "response", None, "a", True), (None, n, "revisit", 1, "n", True)], key=repr)
    index, folder = warc.archive(pages.limit(0))
    assert warc.read_records(index, folder).count() == 0


def test_a_revisit_is_intact_only_with_its_payload(spark):
    long = "y\r\n" * 60
    pages = spark.createDataFrame([(1, "u", long), (2, "v", long), (3, "w", long + "z")], "page_id long, url string, html string")
    index, folder = warc.archive(pages)

    def intact(index):
        return rows_of(warc.read_records(index, folder), "page_id", "intact")

    to = F.when(F.col("page_id") == 2, F.lit(3).cast("long")).otherwise(F.col("refers_to"))
    assert intact(index) == [(1, True), (2, True), (3, True)]
    assert intact(index.where("page_id <> 1")) == [(2, False), (3, True)]
    assert intact(index.withColumn("refers_to", to)) == [(1, True), (2, False), (3, True)]


def test_archive_rows_equal_the_sql(spark):
    import duckdb

    got = warc.op3_warc_normaliser(spark, SF)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{SF}/pages.parquet'")
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({warc.SQL})").fetchall()
    assert rows_of(got, *got.columns) == sorted(want, key=repr)


def test_normaliser_makes_one_member_per_record():
    import gzip
    import io

    parts = [warc.record(i, "u", b"p" * i, "d", i, None) for i in (0, 5, 300_000)]
    out = io.BytesIO()
    index = warc.normalise(io.BytesIO(gzip.compress(b"".join(parts))), out)
    for (at, n, _), part in zip(index, parts):
        assert gzip.decompress(out.getvalue()[at:at + n]) == part
    with pytest.raises(ValueError):
        warc.normalise(io.BytesIO(gzip.compress(parts[2][:-9])), io.BytesIO())


# --- 4 ------------------------------------------------------------------------------

def brute_repeats(texts):
    raw = [(t or "").encode() for t in texts]
    seen = collections.Counter(x[i:i + 200] for x in raw for i in range(len(x) - 199))
    out = []
    for x in raw:
        gone = np.zeros(len(x), bool)
        for i in range(len(x) - 199):
            if seen[x[i:i + 200]] > 1:
                gone[i:i + 200] = True
        spans = int((np.diff(np.concatenate([[False], gone]).astype(int)) > 0).sum())
        out.append((len(x), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(x, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


@pytest.mark.parametrize("limit", [suffix.MAX_SEGMENTS, 1])
def test_repeats_against_brute_force(docs, monkeypatch, limit):
    monkeypatch.setattr(suffix, "MAX_SEGMENTS", limit)             # 1: every shared bucket is split
    ids = [r[0] for r in corpus()]
    want = sorted(((i, *w) for i, w in zip(ids, brute_repeats([r[1] for r in corpus()]))), key=repr)
    assert rows_of(suffix.remove_repeats(docs), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == want


def test_repeats_of_an_empty_table(empty, spark):
    assert suffix.remove_repeats(empty).count() == 0
    assert suffix.cut_stage(spark, empty, SF).count() == 0


def test_columns_find_what_brute_force_finds():
    rng = np.random.default_rng(5)
    anchor = bytes(rng.integers(97, 123, suffix.ANCHOR, np.uint8))
    segs, offs = [], []
    lefts = [bytes(rng.integers(97, 99, 136, np.uint8)) for _ in range(3)]
    rights = [bytes(rng.integers(97, 99, 136, np.uint8)) for _ in range(3)]
    for _ in range(40):
        a, b = int(rng.integers(0, 137)), int(rng.integers(0, 137))
        left, right = lefts[rng.integers(3)], rights[rng.integers(3)]
        if a + b + 64 >= 200:
            segs.append(left[136 - a:] + anchor + right[:b])
            offs.append(a)
    table = suffix.insert_columns(segs, offs)
    at = collections.Counter((136 - o + i, s[i:i + 200]) for s, o in zip(segs, offs) for i in range(len(s) - 199))
    for s, o, row in zip(segs, offs, table):
        for i in range(min(len(s) - 199, o + 1)):
            assert row[136 - o + i] == (at[(136 - o + i, s[i:i + 200])] > 1)


# --- 5 ------------------------------------------------------------------------------

def brute_exact():
    norm = [(r[0], re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or "")) for r in corpus()]
    groups = collections.defaultdict(list)
    for i, t in norm:
        groups[t].append(i)
    return sorted(((i, min((x for x in groups[t] if x is not None), default=None), len(groups[t])) for i, t in norm), key=repr)


def test_exact_against_brute_force(docs, empty, spark):
    for digest_of in (exact.digest, lambda norm: F.substring(exact.digest(norm), 1, 1)):     # the second collides
        got = exact.dedup(docs, digest_of)
        assert rows_of(got, "doc_id", "keep_id", "group_size") == brute_exact()
        assert got.where("kept").count() == len({t for t in (re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or "") for r in corpus())})
    assert exact.dedup(empty).count() == 0
    assert exact.keep_exact(spark, docs, SF).columns == docs.columns


def test_exact_state_goes_on_from_its_checkpoint(spark, tmp_path):
    log, out, checkpoint = (str(tmp_path / x) for x in ("log", "out", "checkpoint"))
    schema = "doc_id long, file string, row long, digest string"
    for rows in ([(5, "f", 0, "a"), (6, "f", 1, "b")], [(2, "g", 0, "a")], [(9, "h", 0, "a"), (1, "h", 1, "c")]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(log)
        exact.run_state(spark, log, spark.createDataFrame([], schema).schema, checkpoint, out, files_per_batch=1)
    got = rows_of(exact.latest_state(spark, out), "digest", "keep.doc_id", "group_size")
    assert got == [("a", 2, 3), ("b", 6, 1), ("c", 1, 1)]


# --- 6 ------------------------------------------------------------------------------

def byte_vocabulary():
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        return f.read()


def test_codec_equals_the_library(docs, empty, spark):
    from tokenizers import Tokenizer

    spec = byte_vocabulary()
    t = Tokenizer.from_str(spec)
    v = lexicon.Vocabulary(spec)
    words = sorted(w.encode() for w in (" the", " then", " there", "er", " words", "the"))
    codec = lexicon.Codec(spec, lexicon.compile_lexicon(words, *v.merged(words)))
    rng = np.random.default_rng(2)
    letters = list("abct hes'tr\n\t  é́\x1c\x85\x0b12中\U0001f600\0\1") + ["<|endoftext|>", " the", " words"]
    texts = ["".join(rng.choice(letters, rng.integers(0, 40))) for _ in range(1500)] + [None, "", "a" * 5000]
    ids, size = codec.encode(texts)
    back = codec.decode(ids, size)
    at = np.cumsum(size) - size
    for x, a, n, b in zip(texts, at, size, back):
        want = t.encode(x or "", add_special_tokens=False).ids
        assert ids[a:a + n].tolist() == want
        assert b == t.decode(want, skip_special_tokens=False)
    assert codec.from_lexicon and codec.unseen
    file = lexicon.publish(spark, spec, lexicon.frequent_pieces(docs))
    got = {r["doc_id"]: r for r in lexicon.encode_documents(docs, spec, file).collect()}
    want = t.encode(corpus()[12][1], add_special_tokens=False).ids
    assert got[12]["n_tokens"] == len(want)
    assert got[12]["ids_sha256"] == hashlib.sha256(",".join(map(str, want)).encode()).hexdigest()
    assert lexicon.encode_documents(empty, spec, lexicon.publish(spark, spec, [])).count() == 0


def test_frequent_pieces_count_over_all_batches(spark):
    """Words thinly spread count like others, whatever the partitions."""
    rows = [(f"alpha w{i} beta{' beta' if i % 2 else ''} line\nend",) for i in range(40)] + [(None,), ("",)]
    docs = spark.createDataFrame(rows, "text string")
    want = ["beta", "alpha", "end", "line", "w", "0", "1"]
    for parts in (1, 42):
        assert lexicon.frequent_pieces(docs.repartition(parts), 7) == want


def test_lexicon_is_minimal_and_exact():
    words = sorted({f"{a}{b}{c}".encode() for a in "abc" for b in "xy" for c in ("", "ing", "ed")})
    lex = lexicon.compile_lexicon(words, np.arange(len(words)), np.ones(len(words), int))
    assert len(lex["accepts"]) < 15                       # shared suffixes
    assert lexicon.look_up(lex, words).tolist() == list(range(len(words)))
    assert set(lexicon.look_up(lex, [b"a", b"axin", b"axings", b"zz", b""]).tolist()) == {-1}
    packed = lexicon.pack(lex)
    import tempfile
    with tempfile.NamedTemporaryFile() as f:
        f.write(packed)
        f.flush()
        assert lexicon.look_up(lexicon.memory_map(f.name), words).tolist() == list(range(len(words)))


# --- 7 ------------------------------------------------------------------------------

def test_languages_on_held_out_documents(spark, docs, empty):
    got = langid.op7_language_id(spark, "/root/testdata/sf0.01")
    truth = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    held = got.where("held_out").join(truth, "doc_id").collect()
    assert np.mean([r["lang_pred"] == r["lang"] for r in held]) >= 0.97
    model = langid.learn(docs.select("text", "lang"))
    odd = {r["doc_id"]: r for r in langid.identify(docs, model).collect()}
    assert odd[0]["lang_pred"] == odd[1]["lang_pred"] == odd[2]["lang_pred"] == "und" and odd[0]["score"] == 0
    assert langid.identify(empty, model).count() == 0
    nothing = langid.learn(empty.select("text", "lang"))
    assert {r["lang_pred"] for r in langid.identify(docs, nothing).collect()} == {"und"}


def test_more_languages_than_one_word_holds(spark):
    rng = np.random.default_rng(11)
    rows = []
    for k in range(150):
        words = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 6)) for _ in range(12)]
        rows += [(10 * k + j, " ".join(rng.choice(words, 30)), f"l{k:03}") for j in range(3)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(2)
    model = langid.learn(table.where("doc_id % 10 < 2"))
    assert len(model["langs"]) == 150 and model["slices"].shape[1] == 3
    got = {r["doc_id"]: r["lang_pred"] for r in langid.identify(table, model).collect()}
    assert np.mean([got[i] == lang for i, _, lang in rows]) >= 0.99


@pytest.mark.parametrize("held", [1, 16])
def test_grams_are_counted_whole_whatever_is_held(spark, monkeypatch, held):
    monkeypatch.setattr(langid, "HELD", held, raising=False)
    rows = [(f"word{i % 5} text of it {chr(97 + i)}", f"l{i % 4}") for i in range(24)]
    want = collections.Counter()
    for text, lang in rows:
        want.update((lang, int(i)) for i in langid.grams([text], langid.letter_table())[0])
    got = langid.count_grams(spark.createDataFrame(rows, "text string, lang string").repartition(3))
    assert {(r["lang"], r["id"]): r["n"] for r in got.collect()} == want


def test_bit_slices_return_every_language():
    ids = np.arange(2000)
    size = 20_000
    slices = np.zeros(size, np.uint64)
    masks = np.array([1 + i % 3 for i in ids], np.uint64)
    for p in range(langid.PROBES):
        np.bitwise_or.at(slices, langid.probe(ids, p, size), masks)
    got = langid.languages_of({"slices": slices}, ids)
    assert ((got & masks) == masks).all() and (got != masks).mean() < 0.1


# --- 8 ------------------------------------------------------------------------------

def brute_components(rows):
    sets = {}
    for i, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        if i is not None:
            sets.setdefault(i, []).append({tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and any(x and y and 100 * len(x & y) >= 75 * len(x | y) for x in sets[a] for y in sets[b]):
                p, q = sorted((find(a), find(b)))
                up[q] = p
    return {i: find(i) for i in sets}


def test_near_duplicates_against_brute_force(docs, empty, spark, monkeypatch):
    want = brute_components([(r[0], r[1]) for r in corpus()])
    for block in (minmax.BLOCK_SHINGLES, 50):             # 50: buckets are cut into blocks
        monkeypatch.setattr(minmax, "BLOCK_SHINGLES", block)
        got = minmax.near_duplicates(docs).collect()
        assert all(r["component_id"] == want.get(r["doc_id"]) for r in got)
        assert all(r["kept"] == (r["doc_id"] is None or r["doc_id"] == r["component_id"]) for r in got)
    assert {r["n_shingles"] for r in got if r["doc_id"] in (0, 1, 2)} == {0}
    assert minmax.near_duplicates(empty).count() == 0


def test_chains_of_near_copies_stay_whole(spark):
    """Neighbours in a chain are linked, far ends aren't: one component."""
    rng = np.random.default_rng(8)
    words = [str(x) for x in rng.choice(WORDS, 150)]
    rows = []
    for i in range(60):
        rows.append((i, " ".join(words)))
        words[(i * 37) % 150] = f"new{i}"
        words[(i * 37 + 70) % 150] = f"new{i}b"
    got = minmax.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = brute_components(rows)
    assert {r["doc_id"]: r["component_id"] for r in got} == want


def test_components_of_random_graphs(spark):
    rng = np.random.default_rng(4)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2)) if a != b]
    up = list(range(300))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        p, q = sorted((find(a), find(b)))
        up[q] = p
    got = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r["node"]: r["component"] for r in got} == {x: find(x) for e in edges for x in e}


# --- 9 ------------------------------------------------------------------------------

def test_packing_is_whole_and_tight(docs, empty):
    from tokenizers import Tokenizer

    spec = vocabulary_text()
    t = Tokenizer.from_str(spec)
    got = packing.pack_documents(docs, spec).toPandas()
    by_seq = got.sort_values(["sequence_id", "offset"]).groupby("sequence_id")
    assert (by_seq["length"].sum() <= 2048).all()
    assert (by_seq["length"].cumsum() - got.sort_values(["sequence_id", "offset"])["length"] == got.sort_values(["sequence_id", "offset"])["offset"]).all()
    want = []
    for r in corpus():
        ids = np.array([*t.encode(r[1] or "", add_special_tokens=False).ids, 0], "<u4")
        want += [(len(ids[k:k + 2048]), zlib.crc32(ids[k:k + 2048].tobytes())) for k in range(0, len(ids), 2048)]
    assert sorted(zip(got["length"], got["ids_crc32"])) == sorted(want)
    assert len(by_seq) == -(-sum(n for n, _ in want) // 2048)
    assert packing.pack_documents(empty, spec).count() == 0


def test_word_ids_equal_the_library():
    from tokenizers import Tokenizer

    spec = vocabulary_text()
    t, w = Tokenizer.from_str(spec), WordBpe(spec, compile_tables(spec))
    rng = np.random.default_rng(6)
    letters = list("abcthE'sr\n\t  é́\x1c\x85\x0b12中ΣİſÅ.,.,") + ["<|endoftext|>", " Word, ", "end. "]
    texts = ["".join(rng.choice(letters, rng.integers(0, 30))) for _ in range(1500)]
    texts += [None, "", "a" * 500 + " b", "." * 300, "don't I'll WE'VE", "x<|startoftext|>y z", "Ж² ½ЙßǅĿ"]
    texts += [f"a{chr(c)}B" for c in range(1, 0x3100) if not 0xD800 <= c < 0xE000]
    ids, size = w.encode(pa.array(texts))
    for x, got in zip(texts, np.split(ids, np.cumsum(size)[:-1])):
        assert got.tolist() == t.encode(x or "", add_special_tokens=False).ids


def test_islands_never_lose_a_piece():
    rng = np.random.default_rng(7)
    lengths = np.concatenate([rng.integers(1, 2048, 400), rng.integers(900, 1300, 200)])
    first = packing.evolve(lengths, 1)
    for bins, room in (first, packing.evolve(lengths, 2, [first]), packing.cross(lengths, first, packing.evolve(lengths, 9), rng)):
        assert sorted(i for b in bins for i in b) == list(range(len(lengths)))
        assert all(lengths[b].sum() + r == 2048 and r >= 0 for b, r in zip(bins, room))
    assert len(packing.evolve(lengths, 2, [first])[0]) <= len(first[0])


def test_crossover_saves_sequences_where_best_fit_is_poor():
    lengths = np.random.default_rng(1).integers(500, 801, 2000)
    bins = []
    packing.best_fit(lengths, np.argsort(-lengths, kind="stable").tolist(), [], bins)
    got, room = packing.evolve(lengths, 1)
    assert sorted(i for b in got for i in b) == list(range(2000))
    assert [2048 - lengths[b].sum() for b in got] == room and min(room) >= 0
    assert len(got) <= 0.98 * len(bins)


def test_many_groups_of_one_piece_a_bin_keep_their_sequences_apart(spark, monkeypatch):
    """Nearly all bins stay open, so the second epoch has as many groups as the first."""
    monkeypatch.setattr(packing, "GROUP", 40)
    rows = [(i, 0, 1025 + i * 7 % 1019) for i in range(2400)]
    items = spark.createDataFrame(rows, "doc_row long, piece int, length long")
    got = packing.pack(items).join(items, ["doc_row", "piece"]).toPandas()
    assert sorted(got["doc_row"]) == list(range(2400))
    assert got.groupby("sequence_id")["length"].sum().max() <= 2048
    assert got["sequence_id"].nunique() == 2400


# --- 10 -----------------------------------------------------------------------------

def test_rules_against_brute_force(docs, empty):
    def brute(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        windows = collections.Counter(tuple(words[i:i + 8]) for i in range(len(words) - 7))
        covered = {k for i in range(len(words) - 7) if windows[tuple(words[i:i + 8])] > 1 for k in range(i, i + 8)}
        base = len(words) < 20 or 100 * len(covered) > 30 * len(words)
        return (len(words), sum(map(len, words)), sum((text or "").count(c) for c in rules.SYMBOLS),
                len(lines) - len(set(lines)), len(covered), base)

    got = rows_of(rules.quality_rules(docs), "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                  "base_failed")
    assert got == sorted(((r[0], *brute(r[1])) for r in corpus()), key=repr)
    assert rules.quality_rules(empty).count() == 0
    plan = rules.quality_rules(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Exchange", plan)


def test_rules_of_texts_without_words(spark, tmp_path):
    """A share of no words is no division by zero, in whichever way Spark evaluates it."""
    import duckdb

    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "the cat sat on a mat of the house and it was good to see that it is in the sun"),
            (6, "# " * 30)]
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/*.parquet'")
    cols = ["doc_id", "word_chars", "n_symbols", "n_words", "n_repeat_words", "n_stop_words", "n_lines", "n_dup_lines", "base_failed", "kept"]
    want = sorted(con.execute(f"SELECT {', '.join(cols)} FROM ({rules.SQL})").fetchall())
    assert [r[0] for r in want if r[-1]] == [5]
    got = rules.op10_quality_rules(spark, str(tmp_path))
    assert sorted(map(tuple, got.select(cols).collect())) == want
    assert [r["doc_id"] for r in got.where("kept").collect()] == [5]
    spark.conf.set("spark.sql.codegen.wholeStage", "false")
    try:
        assert sorted(map(tuple, rules.op10_quality_rules(spark, str(tmp_path)).select(cols).collect())) == want
        assert [r["doc_id"] for r in rules.op10_quality_rules(spark, str(tmp_path)).where("kept").collect()] == [5]
    finally:
        spark.conf.set("spark.sql.codegen.wholeStage", "true")


# --- entry and pipeline ----------------------------------------------------------------

def test_registered_sql_equals_the_queries(spark):
    import duckdb

    from gleaner.llm import registry

    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    for name, sql in registry.SQL.items():
        got, want = registry.QUERIES[name](spark, SF).toPandas(), con.execute(sql).df()
        cols = sorted(got.columns)
        assert cols == sorted(want.columns)
        norm = [sorted(map(repr, d[cols].astype(object).where(d[cols].notna(), None).astype(str).itertuples(index=False, name=None))) for d in (got, want)]
        if name != "op3_warc_normaliser":
            assert norm[0] == norm[1]
        else:
            assert len(norm[0]) == len(norm[1])


def test_pipeline_stages(spark, empty):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    from gleaner.llm.util import store

    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = store(stage(spark, docs, SF), name)
        if name != "packing":
            assert out.columns == docs.columns and out.count() <= docs.count()
        seen[name] = (docs, out)
        assert store(stage(spark, empty.select("doc_id", "text", "lang", "source", "n_chars"), SF), name).count() == 0
        docs = out
    before, after = seen["near"]
    want = brute_components([(r["doc_id"], r["text"]) for r in before.collect()])
    assert {r["doc_id"] for r in after.collect()} == {i for i, c in want.items() if i == c}
    before, after = seen["repeats"]
    old = sorted(before.collect(), key=lambda r: r["doc_id"])
    new = {r["doc_id"]: r["text"] for r in after.collect()}
    for r, (n, gone, _, _) in zip(old, brute_repeats([r["text"] for r in old])):
        assert abs(len(new[r["doc_id"]].encode()) - (n - gone)) <= 6 * (gone > 0)
    assert seen["packing"][1].where("piece = 0").count() == seen["packing"][0].count()


CLASHES = ["score", "Score_", "file", "row", "doc", "digest", "keep", "kept", "key", "key2", "twice", "group_size",
           "component_id", "n_shingles", "set_id", "id", "_gam_score", "_f", "_r", "_k", "_x"]


def test_stages_keep_columns_of_any_name(spark, tmp_path):
    """Extra columns, named as the operators name their own, change nothing; frames that
    aren't read straight from files are fine; nulls, empty and equal texts too."""
    import corpus_pipeline

    plain = spark.createDataFrame([(r[0], r[1]) for r in corpus()], "doc_id long, text string")
    more = plain.select("*", *(F.lit(f"x{i}").alias(c) for i, c in enumerate(CLASHES)))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        want, got = stage(spark, plain, SF), stage(spark, more, SF)
        assert got.columns == more.columns
        assert rows_of(got, "doc_id", "text") == rows_of(want, "doc_id", "text"), name
        assert got.where("key2 <> 'x9' OR file <> 'x2'").count() == 0
    assert stage is not None


def test_exact_stage_against_brute_force(spark):
    import corpus_pipeline

    rows = [(r[0], r[1]) for r in corpus()]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = dict(corpus_pipeline.STAGES)["exact"](spark, docs, SF)
    best = {}
    for i, t in rows:
        norm = re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
        best[norm] = min(best.get(norm, (True, 0)), (i is None, i or 0))
    assert sorted((i is None, i or 0) for (i,) in rows_of(got, "doc_id")) == sorted(best.values())


def test_quality_stage_against_the_scores(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r["doc_id"] for r in dict(corpus_pipeline.STAGES)["quality"](spark, docs, SF).collect()}
    assert got == {r["doc_id"] for r in ga2m.op2_quality_gam(spark, SF).where("predicted = 1").collect()}
