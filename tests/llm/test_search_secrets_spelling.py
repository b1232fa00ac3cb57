"""Ranked search, secret scans and spelling variants: brute force, planted cases, odd rows, forced splits."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from txnlens.llm import lexical_search, queries, secret_scan, spelling

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n bigint, m int, term string, score double, word string, item double"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
RUN = re.compile("[A-Za-zÀ-ÿ]+")
LONG = " ".join(f"w{i % 700}x{i % 11} colour" for i in range(4000))
TEXTS = [
    (1, "Alpha beta beta, GAMMA! 42"), (2, "alpha beta beta gamma 42"), (2, "alpha beta beta gamma 42"), (3, None), (4, ""), (5, " \n--- "),
    (None, "alpha beta beta gamma 42"), (None, None), (6, LONG), (7, "É é naïve ÑANDÚ alpha"), (8, "beta " * 50), (9, "colour color colours Colour"),
    (10, "colour colour color colour " * 3), (-3, "alpha beta beta gamma 42"), (11, "gamma" + "x" * 3000 + " gamma" + "x" * 3000 + "y " * 3),
]
ODD = [(i, t, None, "s", None, k, "t", math.nan, "w", None) for k, (i, t) in enumerate(TEXTS)]


@pytest.fixture(scope="module")
def odd(spark):
    queries.ship(spark)
    return spark.createDataFrame(ODD, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def documents(spark):
    queries.ship(spark)
    return spark.read.parquet(f"{SF}/documents.parquet")


# --- ranked search -------------------------------------------------------------
def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute_search(docs, items, k=10):
    bags = [(i, Counter(TERM.findall(lower(t)))) for i, t in docs]
    bags = [(i, b, sum(b.values())) for i, b in bags if b]
    n_docs, n_all = len(bags), sum(n for *_, n in bags)
    df = Counter(t for _, b, _ in bags for t in b)
    out = []
    for item, text in set(items):
        best = []
        for i, bag, n in bags:
            m = 10 + 90 * n * n_docs // n_all
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * bag[t] // (1000 * bag[t] + 8 * m))
                        for t in set(TERM.findall(lower(text))) if t in bag)
            if score > 0:
                best.append((-score, i is None, i or 0, i))
        out += [(item, r + 1, i, -s) for r, (s, _, _, i) in enumerate(sorted(best)[:k])]
    return Counter(out)


ITEMS = [(1, "alpha BETA gamma"), (1, "alpha BETA gamma"), (2, "colour w3x3 42 ñandÚ"), (3, ""), (4, None), (None, "beta"), (5, "nowhere"), (1, "é naïve")]


@pytest.mark.parametrize("words, visits, block", [(1 << 21, 8, 2048), (40, 1, 1)])
def test_search_equals_brute_force(spark, odd, monkeypatch, words, visits, block):
    monkeypatch.setattr(lexical_search, "SLICE_WORDS", words)
    monkeypatch.setattr(lexical_search, "FIRST_VISITS", visits)
    monkeypatch.setattr(lexical_search, "ITEM_BLOCK", block)
    items = spark.createDataFrame([(*r, 0.0) for r in ITEMS], "item_id bigint, text string, score double")
    got = lexical_search.search_documents(odd, items).collect()
    assert Counter(tuple(r) for r in got) == brute_search(TEXTS, ITEMS)


def test_search_with_many_slices_and_copies(spark, monkeypatch):
    queries.ship(spark)
    monkeypatch.setattr(lexical_search, "SLICE_WORDS", 60)
    monkeypatch.setattr(lexical_search, "FIRST_VISITS", 2)
    rng = np.random.default_rng(5)
    docs = [(i, " ".join(f"t{x}" for x in rng.zipf(1.4, 12) % 200)) for i in range(300)] + [(1000 + i, "t1 t2 t3 t150") for i in range(300)]
    items = [(i, " ".join(f"t{x}" for x in rng.integers(0, 200, 9))) for i in range(12)] + [(99, "t150 t2")]
    index, n_docs, _ = lexical_search.build_index(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(4))
    assert index.where("term IS NULL").selectExpr("max(size(ids))").first()[0] < 60
    for k in (1, 10):
        got = lexical_search.search(index, n_docs, spark.createDataFrame(items, "item_id bigint, text string"), k)
        assert Counter(tuple(r) for r in got.collect()) == brute_search(docs, items, k)


def test_search_of_nothing(spark, odd, none):
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    assert lexical_search.search_documents(none, items).count() == 0
    assert lexical_search.search_documents(odd, items.limit(0)).count() == 0
    assert lexical_search.search_documents(odd.where("doc_id IN (3, 4, 5)"), items).count() == 0


# --- secrets -------------------------------------------------------------------
def found(text):
    return [(kind, text[a:b]) for kind, a, b, *_ in secret_scan.spans_of(text)]


def test_base_spans_are_leftmost_and_dropped_after_matching():
    assert found("PassWord=abcde secret: 'abcdef'") == [("assign", "secret: 'abcdef")]
    assert found("token=token=abcdef") == [("assign", "token=token=abcdef")]
    assert found("ſecret=abcdefg apiKey=abcdefg") == []  # letters are those of ASCII in either case
    assert found("AKIAAKIA" + "Z" * 12 + " AKIA1") == [("access", "AKIAAKIA" + "Z" * 12)]
    assert found("é " + "0a" * 12 + "g" + "0a" * 11) == [("hex", "0a" * 12)]
    mixed = "token = " + "ab12" * 6
    assert [s[0] for s in secret_scan.spans_of(mixed)] == ["assign", "hex"]


@pytest.mark.parametrize("text, literals", [
    ('PREFIX = "sk_live_"\nrest = \'Zx81kQp0Lm\'\nstripe = PREFIX + rest\nclient.auth_header = 1\nc.auth = stripe', ["sk_live_", "Zx81kQp0Lm"]),
    ('a = "zz9q"\nb = a\nc = b\nprivate_key = c + "QQ812x"', ["zz9q", "QQ812x"]),
    ("define('DB_PWD', 'qW3rTy77');", ["qW3rTy77"]), ('os.environ["DB_PWD"] = "abcDEF123"', ["abcDEF123"]),
    ('db_pwd: str = "Tr0ub4dor&3"', ["Tr0ub4dor&3"]), ("curl --pwd T0psecretX http://x", ["T0psecretX"]),
    ("<passphrase>Xml9Secret</passphrase>", ["Xml9Secret"]), ('url = "postgres://me:p4ssw0rdZ@host/db"', ["p4ssw0rdZ"]),
    ("Authorization: Bearer abc.def-123456", ["abc.def-123456"]), ("- name: DB_PWD\n  value: tok99887766", ["tok99887766"]),
    ('const f = `k9J2mQx7Lp`; const signingKey = f;', ["k9J2mQx7Lp"]), ('conn.setPassword("Set9er!x")', ["Set9er!x"]),
    ('pwd = os.getenv("PWD", "fallback77x")', ["fallback77x"]), ('k = "Ab12Cd34"\nconnect(host="h", pwd=k)', ["Ab12Cd34"]),
    ('part = "x9Kq"\ncredential = f"{part}77Lm"', ["x9Kq", "77Lm"]),
])
def test_bound_literals_are_found(text, literals):
    assert [t for kind, t in found(text) if kind == "lexed"] == literals


@pytest.mark.parametrize("text", [
    'pwd_hint = "name of pet99"', 'pwd = "changeme"', 'pwd = "<your-password>"', 'pwd_length = "1234567890"', 'if pwd == "no12345x": go()',
    "The key: the thing we passed don't auth anything", 'pass_path = "/etc/app/keys9"', 'pwd = "short"', 'colour = "Zx81kQp0Lm"',
    'auth = make_new_session', '"""unclosed pwd', "pwd =", "pwd = \n", "(((( pwd = [", 'public_key = "Zx81kQp0Lm"',
])
def test_harmless_literals_are_left_alone(text):
    assert found(text) == []


def test_scan_equals_the_contract(documents, odd):
    listed = ("assign", "access", "hex")
    planted = [(1, 'token = "' + "0af3" * 10 + '" AKIA' + "Q" * 16 + " é secret:abcdef", 0), (None, 'pwd = "Zx81kQp0Lm" api-key=zzzzzzz', 1), (2, "password=12345", 2)]
    plain = documents.sparkSession.createDataFrame(planted, "doc_id bigint, text string, kind int")
    larger = documents.sparkSession.read.parquet(SF.replace("0.001", "0.01") + "/documents.parquet")
    for docs in (larger, odd, plain):
        want = Counter()
        for r in docs.select("doc_id", "text").collect():
            text, spans = r["text"] or "", []
            for m in re.finditer(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
                spans += [(m.start(), 0, m.end())] if len(m[2]) >= 6 else []
            for k, (pattern, least) in enumerate((("AKIA[A-Z0-9]+", 20), ("[0-9a-f]+", 24)), 1):
                spans += [(m.start(), k, m.end()) for m in re.finditer(pattern, text) if len(m[0]) >= least]
            joined = ",".join(f"{listed[k]}:{a}:{b}" for a, k, b in sorted(spans))
            n = Counter(k for _, k, _ in spans)
            want[r["doc_id"], n[0], n[1], n[2], hashlib.sha256(joined.encode()).hexdigest(), joined] += 1
        got = secret_scan.secret_digests(docs).collect()
        kept = [",".join(s for s in r["spans"].split(",") if not s.startswith("lexed")) for r in got]
        assert docs is odd or any(r["n_assign"] and r["n_hex"] for r in got)
        assert Counter((r["doc_id"], r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"], k) for r, k in zip(got, kept)) == want


def test_scan_of_long_lines_chains_and_nothing(spark, none):
    assert secret_scan.secret_digests(none).count() == 0
    chain = 'x0 = "q7W9"\n' + "".join(f"x{i + 1} = x{i} + x{i}\n" for i in range(200)) + 'pwd = x200 + "e2R4t6"'
    assert [t for k, t in found(chain) if k == "lexed"] == ["q7W9", "e2R4t6"]
    assert found('pwd = f(g("aB3dE6gH"), h(k("no"), ("or")))') == [("lexed", "aB3dE6gH")]
    for odd in ("a=f(" * 50_000, "pwd=f(" * 20_000 + ")" * 20_000, "k = k + 'x'\n" * 3000 + "pwd = 1", '"' * 99_999 + " pwd", "pwd = [" * 9_000):
        secret_scan.spans_of(odd)
    queries.ship(spark)
    text = "é" * 500_000 + ' pwd = "Zx81kQp0Lm" ' + "word " * 200_000
    row = secret_scan.scan_secrets(spark.createDataFrame([(1, text)], "doc_id bigint, text string")).first()
    assert [(s["kind"], text[s["start"]:s["end"]], s["name"]) for s in row["found"]] == [("lexed", "Zx81kQp0Lm", "pwd")]


# --- spelling variants ------------------------------------------------------------
def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute_spelling(rows):
    n = Counter()
    for doc_id, text in rows:
        for run in RUN.findall(text or ""):
            run = lower(run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            n[run[:h % len(run)] + run[h % len(run) + 1:] if h % 97 == 0 else run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}
    by_length = {}
    for w in n:
        by_length.setdefault(len(w), []).append(w)
    near = {w: [v for k in (-1, 0, 1) for v in by_length.get(len(w) + k, []) if one_edit(w, v)] for w in n}
    form = {w: min(v, key=lambda x: (-n[x], x)) if v else None for w, v in near.items()}
    form = {w: f if f and n[f] >= 2 * n[w] else None for w, f in form.items()}

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return Counter((w, form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n)


def test_spelling_equals_brute_force(spark, odd, none):
    rng = np.random.default_rng(3)
    stems = ["".join(rng.choice(list("abcdeéñ×ÿ"), rng.integers(4, 8))) for _ in range(120)]
    rows = [(i, " ".join(stems[k] for k in rng.zipf(1.3, 80) % 120)) for i in range(60)]
    rows += [(100 + k, " ".join([w] * c)) for k, (w, c) in enumerate((("aaaaa", 3), ("aaaab", 6), ("aaabb", 12), ("aabbb", 24), ("aaaaaa", 3), ("bbbbb", 200)))]
    more = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    for docs, plain in ((odd, TEXTS), (more, rows)):
        got = spelling.spelling_variants(docs).collect()
        assert got and Counter(tuple(r) for r in got) == brute_spelling(plain)
    assert spelling.spelling_variants(none).count() == 0


def test_hot_blocks_are_cut_into_pieces(spark, monkeypatch):
    queries.ship(spark)
    monkeypatch.setattr(spelling, "TILE", 16)
    monkeypatch.setattr(spelling, "ROWS", 5)
    rng = np.random.default_rng(4)
    words = sorted({"".join(rng.permutation(list("aabbccdd"))) for _ in range(300)} | {"".join(rng.choice(list("abcd"), 8)) for _ in range(300)})
    counts = {w: int(c) for w, c in zip(words, rng.integers(3, 60, len(words)))}
    got = spelling.near_words(spark.createDataFrame(list(counts.items()), "word string, n bigint")).collect()
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    best = {w: min(v, key=lambda x: (-counts[x], x)) for w, v in near.items() if v}
    assert Counter(tuple(r) for r in got) == Counter((w, len(near[w]), counts[b], b) for w, b in best.items())


def test_squared_distances_stay_exact_for_long_words():
    for length in (2047, 2048, 50_000):
        left, right = spelling._Side(["a" * length, "b" * length]), spelling._Side(["a" * (length - 1) + "b", "a" * length])
        assert [(int(i), int(j)) for p, q in spelling.near_pairs(left, right, False) for i, j in zip(p, q)] == [(0, 0)]


def test_terms_are_counted_as_they_are_hashed(spark):
    texts = ["", " ", "a", "a b", "-a-", "\x00a\x7fb\u0080c", "x_y^z9", "caf\u00e9 \U0001f600!\u4e2d", "a\n\n b\r", "[[]]", "0" * 50, "\u00a0"]
    got = spark.createDataFrame(list(enumerate(texts)), "id int, text string").select(
        "id", lexical_search.term_count(F.col("text")).alias("n"))
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString()
    assert [r.n for r in got.orderBy("id").collect()] == [len(lexical_search.term_hashes([t.encode()])[0]) for t in texts]
