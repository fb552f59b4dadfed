"""Small tables with odd rows, and brute force on sf0.001."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.llm import forest, frames, html, leaks, licenses, lines, packing, repeats, ring, secrets
from barloom.llm.common import table
from barloom.llm.queries import tokenizer

SMALL = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"w{i}" for i in range(30_000)) + ". "
TEXTS = [(1, None), (2, ""), (3, " \n\t "), (4, "one two three"), (5, LONG), (5, LONG), (None, "no id at all here, it is true."),
         (7, "Same words stand here in both of these rows, truly."), (8, "Same words stand here in both of these rows, truly."),
         (9, "password = Zx81kQp0Ymm3TT \n\n api_key: 'abcABC123456' ÄÖ 😀")]
CLASHES = ("row", "kept", "length", "size", "rep", "keys", "component", "n_words", "shard", "slot", "_text", "_w", "piece", "u", "tree")


def odd(spark, rows=TEXTS):
    of = spark.createDataFrame(rows, "doc_id long, text string")
    for c in CLASHES:
        of = of.withColumn(c, F.lit("x") if c != "size" else F.lit(None).cast("double"))
    return of


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, "w3 w4 w5 w6 w7 w8"), (1, "w3 w4 w5 w6 w7 w8"), (2, None), (None, ""), (3, "one two three")], "item_id long, text string")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(9, 1, 0), (None, None, None), (9, 1, 0), (5, 0, 1)], "doc_id long, quality int, toxic int")


OPERATORS = {
    "repeats": lambda s, d, b, l: repeats.remove(d),
    "ring": lambda s, d, b, l: ring.shard(d),
    "secrets": lambda s, d, b, l: secrets.digest(secrets.scan(d, secrets.train(d, l))),
    "redact": lambda s, d, b, l: secrets.redact(d, secrets.train(d, l)),
    "forest": lambda s, d, b, l: forest.near_duplicates(d),
    "lines": lambda s, d, b, l: lines.rate(d),
    "licenses": lambda s, d, b, l: licenses.scan(d),
    "frames": lambda s, d, b, l: frames.read_frames(frames.write_frames(d, tokenizer("byte_bpe_50k.json"), frames.fresh_folder(s))),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows_give_one_row_each(spark, bench, labels, name):
    docs = odd(spark)
    assert OPERATORS[name](spark, docs, bench, labels).count() == len(TEXTS)
    assert OPERATORS[name](spark, docs.limit(0), bench, labels).count() == 0


def test_packing_odd_rows(spark):
    path = tokenizer("word_bpe_49k.json")
    got = packing.pack(packing.pieces(odd(spark), path)).toPandas()
    assert got.groupby("doc_id", dropna=False)["piece"].count().sum() > len(TEXTS)
    assert got[got.doc_id == 1]["length"].tolist() == [1]
    assert packing.pack(packing.pieces(odd(spark).limit(0), path)).count() == 0
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert s["offset"].tolist() == [0, *s["length"].cumsum().tolist()[:-1]] and s["length"].sum() <= 4096
    assert got["sequence_id"].nunique() <= -(-int(got["length"].sum()) // 4096) + 1


def test_leaks(spark, bench):
    got = {(r.doc_id, r.item_id, r.n_common) for r in leaks.find(odd(spark), bench).collect()}
    assert got == {(5, 1, 2), (4, 3, 1)}
    assert leaks.find(odd(spark).limit(0), bench).count() == 0 == leaks.find(odd(spark), bench.limit(0)).count()
    kept = leaks.decontaminate(odd(spark), bench)
    assert kept.columns == odd(spark).columns and kept.count() == len(TEXTS) - 3


def test_leaks_brute(spark):
    def sets(name, key):
        out = {}
        for r in table(spark, SMALL, name).collect():
            w = WORD.findall((r.text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
            out[r[key]] = {tuple(w[i:i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()
        return out
    items, docs = sets("benchmark", "item_id"), sets("documents", "doc_id")
    want = {(d, i) for i, s in items.items() for d, t in docs.items() if s and 100 * len(s & t) >= 75 * len(s)}
    assert {(r.doc_id, r.item_id) for r in leaks.find(table(spark, SMALL, "documents"), table(spark, SMALL, "benchmark")).collect()} == want


def test_near_duplicates_brute(spark):
    docs = table(spark, SMALL, "documents")
    sets = {}
    for r in docs.collect():
        w = WORD.findall((r.text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
        sets[r.doc_id] = {tuple(w[i:i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in forest.near_duplicates(docs).collect()}
    assert got == {d: (len(sets[d]), find(d), find(d) == d) for d in sets}
    assert forest.deduplicate(docs).count() == sum(find(d) == d for d in sets)


def test_near_duplicates_in_a_crowded_region(spark):
    """Texts with one long common passage are no copies of it; pairs of them that are alike must all be found."""
    passage = " ".join(f"p{i}" for i in range(120))
    rows = []
    for i in range(1600):
        own = [f"d{i}x{k}" for k in range(44)]
        rows.append((i, f"{passage} {' '.join(own)}"))
        if i < 400:  # the last 22 words are others: 138 of 182 shingles are common
            rows.append((10_000 + i, f"{passage} {' '.join(own[:22])} {' '.join(f'e{i}x{k}' for k in range(22))}"))
    got = {r.doc_id: r.component_id for r in forest.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {d: d - 10_000 if d >= 10_000 else d for d, _ in rows}


def test_repeats_brute(spark):
    docs = table(spark, SMALL, "documents").where("length(text) < 6000")
    raw = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    n = collections.Counter(t[i:i + 400] for t in raw.values() for i in range(len(t) - 399))
    want = {}
    for d, t in raw.items():
        gone = bytearray(len(t))
        for i in range(len(t) - 399):
            if n[t[i:i + 400]] > 1:
                gone[i:i + 400] = b"\x01" * 400
        spans = len(re.findall(b"\x01+", bytes(gone)))
        want[d] = (len(t), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(t, gone) if not g)).hexdigest())
    assert sum(w[1] for w in want.values()) > 0
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.remove(docs).collect()}
    assert got == want


def test_secrets_brute(spark, labels):
    docs = table(spark, SMALL, "documents")
    kinds = {"assign": re.compile(r"(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|"
                                  r"[aA][pP][iI]_?[kK][eE][yY])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"),
             "access": re.compile("(AKIA[A-Z0-9]+)"), "hex": re.compile("([0-9a-f]+)")}
    least = {"assign": 12, "access": 18, "hex": 16}
    got = {r.doc_id: (r.n_assign, r.n_access, r.n_hex, r.base_sha256)
           for r in secrets.digest(secrets.scan(docs, secrets.train(docs, table(spark, SMALL, "labels")))).collect()}
    for r in docs.collect():
        spans = [(m.start(), i, f"{k}:{m.start()}:{m.end()}") for i, (k, p) in enumerate(kinds.items())
                 for m in p.finditer(r.text or "") if len(m[1]) >= least[k]]
        counts = tuple(sum(s[1] == i for s in spans) for i in range(3))
        assert got[r.doc_id] == (*counts, hashlib.sha256(",".join(s[2] for s in sorted(spans)).encode()).hexdigest())


def test_redaction_hides_values_and_keeps_documents(spark, labels):
    docs = odd(spark)
    got = {r.doc_id: r.text for r in secrets.redact(docs, secrets.train(docs, labels)).collect()}
    assert "Zx81kQp0Ymm3TT" not in got[9] and "abcABC123456" not in got[9] and got[9].endswith("ÄÖ 😀") and got[1] is None


def test_frames_brute(spark):
    from tokenizers import Tokenizer
    import numpy as np
    path = tokenizer("byte_bpe_50k.json")
    enc = Tokenizer.from_file(path)
    docs = table(spark, SMALL, "documents")
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in
           frames.read_frames(frames.write_frames(docs, path, frames.fresh_folder(spark))).collect()}
    at = 0
    for r in docs.orderBy("doc_id").collect():
        ids = [*enc.encode(r.text or "", add_special_tokens=False).ids, 2]
        assert got[r.doc_id] == (at, len(ids), zlib.crc32(np.asarray(ids, "<u4").tobytes()))
        at += len(ids)


def test_ring_law(spark):
    docs = table(spark, SMALL, "documents")
    text = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    got = ring.shard(docs).toPandas()
    assert set(got["law"]) == {"rows"} and got["shard"].between(0, 39).all() and got["grown_shard"].isna().all()
    assert len(got) == len(text) and got["shard"].nunique() == 40
    assert got["shard"].value_counts().max() - got["shard"].value_counts().min() <= 1
    assert all((r.size, r.text_crc32) == (len(text[r.doc_id]) + 16, zlib.crc32(text[r.doc_id])) for r in got.itertuples())
    for _, s in got.groupby("shard"):
        assert sorted(s["slot"]) == list(range(len(s)))


def test_lines_reject_furniture_and_keep_prose(spark):
    prose = " ".join(f"Sentence {n} of a clean text says thing {n * 7}." for n in range(12))
    menu = "\n".join(f"Home | News {i} | Sport {i} | About | Login" for i in range(12))
    got = {r.doc_id: r for r in lines.rate(spark.createDataFrame([(1, prose), (2, menu), (3, prose + "\nClick here")], "doc_id long, text string")).collect()}
    assert got[1].kept and not got[2].kept and got[3].kept and got[3].clean_text == prose


def test_licenses_read_the_order(spark):
    rng = np.random.default_rng(4)
    notice = licenses.NOTICES["mpl-2.0"].split()
    turned = [w for k in range(len(notice) // 5, -1, -1) for w in notice[5 * k:5 * k + 5]]  # every four-gram within a piece, pieces backwards
    gaps = [w for i, w in enumerate(notice) for w in ([w, "really"] if i == 12 else [w]) if i != 20]
    whole = " ".join(licenses.WHOLE["isc"].split())
    docs = spark.createDataFrame([(1, " ".join(notice)), (2, " ".join(turned)), (3, "so. " + " ".join(gaps) + " end"), (4, whole), (5, None)],
                                 "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.scan(docs).collect()}
    assert [got[i].labels for i in range(1, 6)] == ["mpl-2.0", "", "mpl-2.0", "isc", ""]
    assert got[4].n_spans == 2 and got[4].score == 1.0
    for _ in range(200):
        a, b = ([str(x) for x in rng.integers(0, 6, rng.integers(1, 30))] for _ in "ab")
        table = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1, j + 1] = table[i, j] + 1 if x == y else max(table[i, j + 1], table[i + 1, j])
        assert licenses.common_in_order(a, b) == table[-1, -1]


def test_licenses_base_places_over_the_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: r for r in licenses.scan(docs).collect()}
    for d in docs.collect():
        text = "".join(ch.lower() if "A" <= ch <= "Z" else ch for ch in d.text or "")
        words = [w for w in re.split(licenses.NOT_WORD, text) if w]
        at = [i for phrase in licenses.BASE for i in range(len(words)) if words[i:i + len(phrase.split())] == phrase.split()]
        r = got[d.doc_id]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(words), len(at), min(at, default=None), max(at, default=None))


def test_licenses_base(spark):
    docs = spark.createDataFrame([(1, "Text under CC-BY terms. All rights   reserved"), (2, "The GENERAL public License"), (3, "all rights are reserved")],
                                 "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.scan(docs).collect()}
    assert (got[1].n_base, got[1].first_word, got[1].last_word, got[1].base_labels) == (2, 2, 5, "cc-by,reserved")
    assert (got[2].n_base, got[2].base_labels) == (1, "gpl") and (got[3].n_base, got[3].first_word, got[3].base_labels) == (0, None, "")


def test_pages(spark):
    article = "".join(f"<p>The {i}th paragraph of the article &amp; its story goes\n on for quite a while, with enough words to read.</p>" for i in range(5))
    page = ("<html><body><nav><ul><li><a href='/'>Home</a></li><li><a href='/a'>About</a></li></ul></nav><article><h1>Title of it</h1>"
            f"{article}</article><footer>Imprint</footer><script>var a = '<p>no</p>';</script></body></html>")
    got = {r.page_id: r for r in html.extract(spark.createDataFrame([(1, "u", page), (2, None, None), (3, "v", "")], "page_id long, url string, html string")).collect()}
    text = got[1].text
    assert "2th paragraph of the article & its story goes on for" in text and "Imprint" not in text and "About" not in text and "var a" not in text
    assert got[1].n_chars == len(text) and got[2].text == "" and got[3].n_chars == 0


@pytest.mark.parametrize("start, end", [("<div class='overflow-hidden'>", "</div>"), ("<div class='layout has-sidebar'>", "</div>"), ("<div id='page' class='page with-header'>", "</div>"),
                                        ("<form action='./default.aspx'>", "</form>"), ("<header>", "</header>")])
@pytest.mark.parametrize("tag", ["article", "div"])
def test_html_wrappers_named_like_furniture(start, end, tag):
    story = "".join(f"<p>The {i}th paragraph of the story goes on for a while, with many plain words.</p>" for i in range(6))
    page = (f"<html><body>{start}<nav><a href='/'>Home</a></nav><{tag}>{story}<div class='share'><a href='/1'>Send</a> <a href='/2'>Post</a></div></{tag}>"
            f"<footer>Imprint</footer>{end}</body></html>")
    assert html.main_text(page).splitlines() == [f"The {i}th paragraph of the story goes on for a while, with many plain words." for i in range(6)]


def test_html_nearest_article():
    story = "".join(f"<p>The {i}th paragraph of the story goes on for a while, with many plain words.</p>" for i in range(6))
    page = f"<html><body><main><p>Short note.</p><article>{story}</article></main></body></html>"
    assert html.main_text(page).splitlines() == [f"The {i}th paragraph of the story goes on for a while, with many plain words." for i in range(6)]


def test_repeats_crowded(spark):
    """A passage between different neighbours in many rows: every gram of it is crowded; blocks give what whole groups give."""
    common = " ".join(f"c{i * 37 % 101}" for i in range(220))
    tail = " ".join(f"t{i}" for i in range(90))
    rows = [(i, " ".join(f"a{i}x{k}" for k in range(30)) + common[i % 9:] + (tail if i % 3 else "") + " ".join(f"b{i}x{k}" for k in range(60))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    raw = {d: t.encode() for d, t in rows}
    n = collections.Counter(t[i:i + 400] for t in raw.values() for i in range(len(t) - 399))
    want = {}
    for d, t in raw.items():
        gone = bytearray(len(t))
        for i in range(len(t) - 399):
            if n[t[i:i + 400]] > 1:
                gone[i:i + 400] = b"\x01" * 400
        want[d] = hashlib.sha256(bytes(c for c, g in zip(t, gone) if not g)).hexdigest()
    for crowded in (3, 1024):
        assert {r.doc_id: r.kept_sha256 for r in repeats.remove(docs, crowded=crowded).collect()} == want
