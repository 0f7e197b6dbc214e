"""Each training-data operator on small inputs: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns, and
its result against a brute-force statement of the contract."""

import hashlib
import itertools
import math
import random
import re
import time
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tracelake.llm import leaks, licences, near, neighbours, packing, pages, pii, quality, toxicity, urls
from tracelake.llm import queries as Q

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, score double, node long, sig long"


def docs(spark, texts, start=0):
    rows = [(start + i, t, "en", 0.5, 1, 2) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def texts():
    """Awkward texts."""
    return [None, "", " \t\n", "a", "A a a", "é ü ñ 中文 ß", "x" * 5000, "word " * 3000, "same text here", "same text here", "<|endoftext|> a<|ENDOFTEXT|>b 1.2.3.4"]


# Packing ---------------------------------------------------------------------------------------------------------------------


def check_packing(rows, cap=4096):
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= cap
    return len(by)


def test_packing_round_trip(spark, texts):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(Q.tokenizer_path())
    rows = packing.pack_documents(docs(spark, texts), Q.tokenizer_path()).collect()
    of = defaultdict(list)
    for r in rows:
        of[r["doc_id"]].append(r)
    assert set(of) == set(range(len(texts)))
    for i, t in enumerate(texts):
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        got = sorted(of[i], key=lambda r: r["piece"])
        assert [(r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got] == [(k, s, len(ids[s : s + 4096]), zlib.crc32(ids[s : s + 4096].tobytes())) for k, s in enumerate(range(0, len(ids), 4096))]
    assert check_packing(rows) <= -(-sum(r["length"] for r in rows) // 4096) + 1
    assert packing.pack_documents(docs(spark, []), Q.tokenizer_path()).count() == 0
    ids = [None, 2**60 + 1, 2**60 + 1, -5]
    odd = spark.createDataFrame([(i, "a b") for i in ids], "doc_id long, text string")
    assert sorted(packing.pack_documents(odd, Q.tokenizer_path()).toArrow().column("doc_id").to_pylist(), key=str) == sorted(ids, key=str)


def test_word_ids_equal_the_tokenizer():
    from tokenizers import Tokenizer

    tok, ids = Tokenizer.from_file(Q.tokenizer_path()), packing.WordIds(Q.tokenizer_path())
    rng = random.Random(3)
    signs = "abZé\u0308É ñ'’,.!|*$12½٣<|endoftext|>ßΣİſ中\u00ad\u200d\n\t\x0b\x1c\x85\xa0ǅ"
    for _ in range(2000):
        t = "".join(rng.choice(signs) for _ in range(rng.randint(0, 40)))
        assert ids.ids([t])[0].tolist() == tok.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("score", ["norm", "dot"])
def test_best_fit_keeps_every_capacity(score):
    rng = np.random.default_rng(1)
    n = rng.integers(1, 900, 500)
    cap = packing.Capacity(1000, 4, 900_000.0, (1.0, 0.5, 0.5), score)
    bins, offset = packing.best_fit(n, np.ones(500), n.astype(float) ** 2, cap)
    for b in range(bins.max() + 1):
        own = n[bins == b]
        assert own.sum() <= 1000 and len(own) <= 4 and (own.astype(float) ** 2).sum() <= 900_000 * 1.000001 or len(own) == 1
        assert sorted(offset[bins == b]) == np.concatenate([[0], np.cumsum(own[np.argsort(offset[bins == b])])[:-1]]).tolist()


def brute_best_fit(n, docs, cost, cap):
    """The sequences one by one, in plain sums."""
    bins, room = [], []
    for i in sorted(range(len(n)), key=lambda i: -n[i]):
        d = (n[i] / cap.tokens, docs[i] / cap.documents, cost[i] / cap.cost)
        best = None
        for k, r in enumerate(room):
            if all(x >= y - 1e-12 for x, y in zip(r, d, strict=True)):
                left = [x - y for x, y in zip(r, d, strict=True)]
                s = sum(w * x * x for w, x in zip(cap.weights, left, strict=True)) if cap.score == "norm" else -sum(w * x * y for w, x, y in zip(cap.weights, r, d, strict=True))
                if best is None or s < best[0]:
                    best = s, k
        if best is None:
            room.append([1.0, 1.0, 1.0])
            best = 0, len(room) - 1
        room[best[1]] = [x - y for x, y in zip(room[best[1]], d, strict=True)]
        bins.append((i, best[1]))
    return [b for _, b in sorted(bins)]


@pytest.mark.parametrize("score", ["norm", "dot"])
def test_best_fit_equals_brute_force_and_every_capacity_rejects(score):
    n = np.random.default_rng(3).integers(1, 700, 300)
    used = {}
    wide = dict(tokens=1024, documents=2**20, cost=2.0**40)  # binary fractions, so that ties are exact
    for name, more in {"tokens": {}, "documents": {"documents": 2}, "cost": {"cost": 2.0**19}, "weights": {"weights": (1.0, 0.0, 0.0), "documents": 32, "cost": 2.0**20}, "weighed": {"documents": 32, "cost": 2.0**20}}.items():
        cap = packing.Capacity(**wide | {"weights": (1.0, 0.0625, 0.0625), "score": score} | more)
        bins, _ = packing.best_fit(n, np.ones(300), n.astype(float) ** 2, cap)
        want = brute_best_fit(n.tolist(), [1] * 300, [float(x) ** 2 for x in n], cap)
        assert len(set(bins.tolist())) == len(set(want)) and {frozenset(np.flatnonzero(bins == b)) for b in set(bins.tolist())} == {frozenset(i for i, x in enumerate(want) if x == b) for b in set(want)}
        used[name] = tuple(want)
    assert len(set(used["documents"])) > len(set(used["tokens"])) and len(set(used["cost"])) > len(set(used["tokens"]))
    assert used["weights"] != used["weighed"]


# Personal data ---------------------------------------------------------------------------------------------------------------


def base_spans(t):
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [("card", m.start(), m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 13 <= len(d := re.sub(r"[ -]", "", m[0])) <= 19 and pii.luhn(d)]
    return out + [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub(r"[^0-9]", "", m[0])) <= 15]


def test_spans_equal_the_patterns():
    rng = random.Random(2)
    parts = ["a@b.c", "@", ".", "1", "255", "256.", "0", "+1", " ", "-", "(", ")", "4111 1111 1111 1111", "a.b", "+49 (30) 123-4567", "x", "10.0.0.1", "é", "://", "IBAN ", "007"]
    for _ in range(5000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        found = pii.find_spans(t)
        assert [(k, a, b) for k in pii.KINDS for a, b in found[k]] == base_spans(t), t


@pytest.mark.parametrize("anchor", ["token=", "://", "password:", "@a.", "+1(", "a://,", "iban ", "token token=", "1.", "1 ", "secret='"])
def test_long_runs_of_anchors_take_linear_time(anchor):
    text = anchor * (10**6 // len(anchor))
    start = time.process_time()
    pii.find_spans(text)
    whole = time.process_time() - start
    start = time.process_time()
    pii.find_spans(text[: len(text) // 4])
    assert whole < 8 * (time.process_time() - start) + 0.5


def test_secret_forms():
    def found(t):
        return [t[a:b] for a, b in pii.find_spans(t)["secret"]]

    assert found("Authorization: Bearer abcDEF123456789 x") == ["abcDEF123456789"]
    assert found('token = "abcdefghijkl"') == ["abcdefghijkl"] and found('secret="1234567890123";') == ["1234567890123"]
    assert found("the bearer carried it; token = yes; password: please; pwd=12345678") == []
    assert found("token=token=token=abcdefg1") == ["token=token=abcdefg1"] and found("'password': 'p4ssw0rdX'.") == ["p4ssw0rdX"]
    assert found("bearer of seventeen 1234567890 letters") == []


def test_pii_digest_and_redaction(spark, texts):
    own = [*texts, "mail Bob.x@ex-1.org, card 4111-1111-1111-1111; IBAN: DE44500105175407324931 see http://a.b/c."]
    rows = {r["doc_id"]: r for r in pii.pii_digest(docs(spark, own)).collect()}
    assert len(rows) == len(own)
    for i, t in enumerate(own):
        want = ",".join(f"{k}:{a}:{b}" for k, a, b in base_spans(t or ""))
        assert rows[i]["base_sha256"] == hashlib.sha256(want.encode()).hexdigest()
    assert "account:" in rows[len(own) - 1]["spans"] and "url:" in rows[len(own) - 1]["spans"]
    d = docs(spark, own).withColumn("n_chars", F.length("text").cast("long"))
    new = pii.redact_pii(d)
    assert new.columns == d.columns
    got = {r["doc_id"]: r for r in new.collect()}
    last = got[len(own) - 1]
    assert last["text"] == "mail [EMAIL], card [CARD]; IBAN: [ACCOUNT] see http://a.b/c." and last["n_chars"] == len(last["text"])
    assert got[0]["text"] is None and got[7]["text"] == texts[7]


def test_secrets():
    for text in ('x token = "f3ef4d6b2755a36d7d9c25bd72c4d5f67e061fda" y', "API_KEY: abcd1234efgh.", "my_Password='hunter22!!'", '{"client_secret": "a1b2c3d4e5"}', "pwd=longer1pass, then"):
        found = pii.find_spans(text)["secret"]
        assert len(found) == 1 and pii.redacted(text, {"secret": found}, ("secret",)).count("[SECRET]") == 1, text
    a, b = pii.find_spans("token = 'f3ef4d6b27'")["secret"][0]
    assert (a, b) == (9, 19)
    for text in ("the token: nothing here", "tokens = abcdefgh1", "password required: yes", "secret", "token=", "token = 12.05.2020", "token :", "pwd: short1"):
        assert not pii.find_spans(text)["secret"], text


def test_secrets_of_the_given_documents(spark):
    """Every document with a name, = or : and a long hexadecimal value has a span there; most documents have none."""
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()
    given = re.compile(r"(?i)\b(?:token|secret|password|api_key)\s?[=:]\s?[\"']?[0-9a-f]{16,}")
    have = [(bool(given.search(r["text"] or "")), bool(pii.find_spans(r["text"])["secret"])) for r in rows]
    assert all(found for there, found in have if there) and any(there for there, _ in have)
    assert all(there for there, found in have if found)


def test_pii_of_nothing_and_overlaps(spark):
    assert pii.pii_digest(docs(spark, []).limit(0)).count() == 0
    assert pii.redact_pii(docs(spark, []).limit(0)).count() == 0
    text = "token = a1@example.org and http://10.0.0.1/x"
    spans = pii.find_spans(text)
    assert spans["email"] == [(8, 22)] and spans["secret"] == [(8, 22)] and spans["ip"] == [(34, 42)] and spans["url"] == [(27, 44)]
    assert pii.redacted(text, spans, ("email", "ip", "secret")) == "token = [EMAIL] and http://[IP]/x"


def test_accounts_in_all_spellings():
    for cue in ("Account No", "Account Number", "ACCOUNT number", "Passport No", "Tax ID", "Iban No", "iBAN", "Acct"):
        t = f"\u0130\u00df {cue}: 12345678."
        assert [t[a:b][-8:] for a, b in pii.find_spans(t)["account"]] == ["12345678"], cue
    for iban in ("GB29 NWBK 6016 1331 9268 19", "NL91 ABNA 0417 1643 00", "IE29 AIBK 9311 5212 3456 78", "IT60 X054 2811 1010 0000 0123 456", "MT84 MALT 0110 0001 2345 MTLC AST0 01S", "DE44500105175407324931"):
        for cue in ("IBAN ", "Iban No: "):
            t = f"pay to {cue}{iban} now"
            assert [t[a:b] for a, b in pii.find_spans(t)["account"]] == [iban]
    assert pii.find_spans("IBAN GB28 NWBK 6016 1331 9268 19")["account"] == []


# Pages -----------------------------------------------------------------------------------------------------------------------

PAGE = """<html><head><title>T</title><script>var a="<p>no</p>";</script></head><body><header>Site</header><nav><ul><li><a href=/>Home</a></li></ul></nav>
<div class="cookie-notice">We use cookies, really.</div><main><article><h1>Head &amp; line</h1><p>First, a  paragraph
of text.<br>Still first.<p>Second one, with <b>bold</b> text.<ul><li>item</ul><div class="comments"><p>A reader says something, at length, here.</p></div></article></main>
<aside>Side bar, with words.</aside><form><label>Name</label></form><footer>&copy; foot</footer></body></html>"""


def test_main_text():
    assert pages.main_text(PAGE) == "Head & line\nFirst, a paragraph of text. Still first.\nSecond one, with bold text.\nitem"
    plain = "<div id=menu>a b c</div><div class=body><p>A long paragraph, with marks. And more, here.</p><p>Another one, as long as that. Yes.</p></div><div class=footer>x</div>"
    assert pages.main_text(plain) == "A long paragraph, with marks. And more, here.\nAnother one, as long as that. Yes."
    for odd in (None, "", "<", "<p", "a < b", "<!-- open", "<script>x", "</p></div>", "<p>" * 3000):
        assert isinstance(pages.main_text(odd), str)


LEAD = "A first long paragraph, with marks. And more of it here, too."
REST = "Another paragraph, as long as that one. It goes on, and on."


@pytest.mark.parametrize(
    "wrap",
    ['<html style="overflow:hidden">{}', '<body class="overflow-hidden">{}', '<article data-x="hidden menu">{}</article>', '<main style="overflow: hidden">{}</main>', '<div class="content has-sidebar">{}</div>', '<div class="with-menu"><div id="page-header-search">{}</div></div>', "<body style='display:none'>{}"],
)
def test_wrappers_keep_their_text(wrap):
    assert pages.main_text(wrap.format(f"<p>{LEAD}</p><p>{REST}</p>")) == f"{LEAD}\n{REST}"


def test_hidden_elements_and_marked_parts_go():
    for gone in ("hidden", "hidden=''", "aria-hidden='true'", "style='color:red; display : none'", "style=visibility:hidden", "class=sidebar"):
        page = f"<body><div class='content with-menu'><p>{LEAD}</p><p>{REST}</p><div {gone}><p>Not this, please.</p></div></div>"
        assert pages.main_text(page) == f"{LEAD}\n{REST}", gone


def test_text_beside_the_inner_element_stays():
    inner = "".join(f"<p>{REST}</p>" for _ in range(15))
    page = f"<body><div class=menu><a>x</a></div><div class=page><h1>The heading, here</h1><section>{LEAD}</section><div class=inner>{inner}</div></div><div class=footer>y</div>"
    assert pages.main_text(page) == "\n".join(["The heading, here", LEAD, *[REST] * 15])


LINKS = "".join(f"<li><a href=/{w}>{w} more</a></li>" for w in "one two three four five six".split())
LOOSE = f"<body><h1>The heading, here</h1><p>{LEAD}</p><p>{REST}</p><p>Short.</p><div class=x><ul>{LINKS}</ul></div><div class=y><span>tag</span></div></body>"


def test_the_threshold_selects():
    """Nothing in this page but the ratios tells the article from the rest."""
    assert pages.main_text(LOOSE) == f"The heading, here\n{LEAD}\n{REST}\nShort."
    assert "four more" in pages.main_text(LOOSE, 0.0) and "tag" in pages.main_text(LOOSE, 0.0)


def test_articles_and_their_headers():
    two = f"<body><nav>x</nav><article><header><h1>Title</h1></header><p>{LEAD}</p></article><article><p>{REST}</p><footer>by me</footer></article></body>"
    assert pages.main_text(two) == f"Title\n{LEAD}\n{REST}"
    assert pages.main_text(f"<div class=search-and-rescue><p>{LEAD}</p></div><p>{REST}</p>") == f"{LEAD}\n{REST}"
    reader = f"<article><p>{LEAD}</p><div class=comments><article class=comment><p>{REST}</p><p>{REST}</p><p>{REST}</p></article></div></article>"
    assert pages.main_text(reader) == LEAD


def test_path_statistics():
    """The scores against sums made from the paths as written out."""
    p = pages.Page(LOOSE)
    names = {0: ()}
    for (up, name), k in p.paths.items():
        names[k] = (*names[up], name)
    seen = {names[p.path[e]]: 0 for t, e, _ in p.runs if t.strip()}
    for t, e, _ in p.runs:
        seen[names[p.path[e]]] += len(t.strip())
    assert seen == {("body", "h1"): 17, ("body", "p"): len(LEAD + REST) + 6, ("body", "div.x", "ul", "li"): 6 * 5 + 22, ("body", "div.y"): 3}
    assert {names[g] for g in p.content_paths(0.2, 7)} == {("body", "h1"), ("body", "p")}


@pytest.mark.parametrize("page", ["<a " * 10**6, "<div>x" * 10**5, "<span><article>" + "<div>" * 10**5 + "</span>" * 10**5, "<b>" * 10**5 + "<div></div>" * 10**5, "<a x='" * 10**5])
def test_broken_pages_take_linear_time(page):
    start = time.time()
    pages.main_text(page)
    assert time.time() - start < 20


def test_extract(spark):
    assert pages.extract_text(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []
    d = spark.createDataFrame([(1, "u", PAGE, "x"), (2, None, None, "y"), (1, "u", PAGE, "x")], "page_id long, url string, html string, text string")
    rows = pages.extract_text(d).collect()
    assert len(rows) == 3 and all(r["n_chars"] == len(r["text"]) for r in rows)


# Neighbours ------------------------------------------------------------------------------------------------------------------


def test_neighbours_recall_and_odd_rows(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(600, 16)) + 2 * rng.normal(size=(6, 16))[rng.integers(0, 6, 600)]
    x[50:250] = x[50]  # a third are copies
    rows = [(i, v.tolist(), 1, [0.0]) for i, v in enumerate(x)]
    rows += [(1000, None, 1, None), (1100, [0.0] * 16, 1, None), (1200, [float("nan")] + [1.0] * 15, 1, None), (1300, [None] + [1.0] * 15, 1, None), (1400, [1.0], 1, None)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>, list int, v array<double>")
    got = defaultdict(list)
    for r in neighbours.nearest(d, longest=40).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == set(range(0, 600, 100))
    hits = []
    for q, near10 in got.items():
        near10.sort()
        dist = np.sqrt(((x - x[q]) ** 2).sum(1))
        dist[q] = np.inf
        best = np.lexsort((np.arange(600), dist))[:10]
        hits.append(len(set(best) & {v for _, v, _ in near10}) / 10)
        assert [r for r, _, _ in near10] == list(range(1, 11))
        assert all(abs(s - dist[v]) < 1e-12 for _, v, s in near10)
    assert np.mean(hits) >= 0.9
    assert neighbours.nearest(d.filter("vec_id > 900")).count() == 0


def test_lonely_queries_have_all_neighbours(spark):
    """Outliers that are centroids by themselves, copies of one id around a query, and list cuts on the query side."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(900, 8))
    for i in range(0, 900, 100):
        x[i] = 0
        x[i, i // 100 % 8] = 1000 + i
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1, (x[100] + 0.001).tolist())] * 60
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for most in (4000, 2):
        got = defaultdict(list)
        for r in neighbours.nearest(d, most_asked=most).collect():
            got[r["query_id"]].append((r["rank"], r["vec_id"]))
        assert set(got) == set(range(0, 900, 100))
        assert all(sorted(r for r, _ in near10) == list(range(1, 11)) and len({v for _, v in near10}) == 10 for near10 in got.values())
        assert (1, 1) in got[100]


# Licences --------------------------------------------------------------------------------------------------------------------


def test_licences_equal_sql(spark, texts):
    own = [*texts, "Released UNDER the MIT license. under the mit license", "Apache License, Version 2.0 cc-by-nc 4.0", "mit the under license", "GNU General Public License, version 3; all rights reserved"]
    own += [licences.MORE["mit-text"][1], "x " + licences.MORE["bsd"][1].replace("retain", "keep"), licences.BASE["apache-2"][1][:120], licences.MORE["isc"][0]]
    d = docs(spark, own)
    con = duckdb.connect()
    frame = d.select("doc_id", "text").toPandas()  # noqa: F841
    con.execute("create view documents as select * from frame")
    want = con.execute(licences.digest_sql())
    names = [c[0] for c in want.description]
    got = licences.licence_digest(d)
    assert sorted(got.columns) == sorted(names)
    assert sorted(map(tuple, got.select(*names).collect()), key=repr) == sorted(want.fetchall(), key=repr)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert licences.licence_digest(docs(spark, [])).count() == 0
    # A word put in, and one left out, cost the pairs around them.
    words = licences.MORE["bsd"][1].split()
    bent = [" ".join(words), " ".join([*words[:12], "kindly", *words[12:]]), " ".join(words[:13] + words[14:])]
    shares = [r["score"] for r in licences.licence_digest(docs(spark, bent)).orderBy("doc_id").collect()]
    assert shares[0] == 1.0 and all(0.9 < x < 1 for x in shares[1:]), shares


# Quality and toxicity --------------------------------------------------------------------------------------------------------


def labels(spark, n, quality, toxic):
    return spark.createDataFrame([(i, quality(i), toxic(i)) for i in range(n)], "doc_id long, quality int, toxic int")


def test_quality(spark, texts):
    rng = random.Random(1)
    words = ["alpha", "beta", "gamma", "delta", "omega", "stream", "table"]

    def text(i):
        w = [rng.choice(words) for _ in range(rng.randint(5, 60))]
        return " ".join(x.upper() + "!!" for x in w) if i % 3 == 0 else " ".join(w) + "."

    d = docs(spark, [text(i) for i in range(400)])
    model = quality.train_quality(d, labels(spark, 400, lambda i: int(i % 3 != 0), lambda i: 0))
    rows = quality.score_quality(d, model).collect()
    held = [r for r in rows if r["held_out"]]
    assert len(rows) == 400 and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    assert np.mean([r["predicted"] == int(r["doc_id"] % 3 != 0) for r in held]) > 0.95
    odd = quality.score_quality(docs(spark, texts), model).collect()
    assert len(odd) == len(texts) and all(0 <= r["score"] <= 1 for r in odd)
    none = quality.train_quality(d, labels(spark, 0, None, None) if False else labels(spark, 3, lambda i: None, lambda i: None))
    assert quality.score_quality(docs(spark, texts), none).count() == len(texts)


def test_toxicity(spark, texts):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(300)]

    def text(i):
        w = [rng.choice(words) for _ in range(rng.randint(3, 120))]
        if i % 4 == 0:
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(["badword", "nastyone", "uglyterm"]))
        return " ".join(w)

    d = docs(spark, [text(i) for i in range(600)])
    net = toxicity.train_toxicity(d, labels(spark, 600, lambda i: 1, lambda i: int(i % 4 == 0)))
    rows = toxicity.score_toxicity(d, net).collect()
    held = [r for r in rows if r["held_out"]]
    assert np.mean([r["predicted"] == int(r["doc_id"] % 4 == 0) for r in held]) > 0.95
    odd = toxicity.score_toxicity(docs(spark, texts), net).collect()
    assert len(odd) == len(texts) and all(0 <= r["score"] <= 1 for r in odd)
    kept = toxicity.drop_toxic(d, net)
    assert kept.columns == d.columns and kept.count() == sum(not r["predicted"] for r in rows)
    far = " ".join(["w1"] * 5000 + ["badword", "nastyone"] + ["w2"] * 5000)  # one bad window in a long text
    assert toxicity.score_toxicity(docs(spark, [far]), net).first()["predicted"] == 1


def slow_quality(model, text):
    """The score by adding up table entries, one comparison after the other."""
    x = quality.features(text)
    bins = []
    for v, cuts in zip(x, model.cuts, strict=True):
        at = 0
        while at < len(cuts) and v >= cuts[at]:
            at += 1
        bins.append(at)
    raw = model.base
    for b, t in zip(bins, model.tables, strict=True):
        raw += t[b]
    for (j, k), t in zip(model.pairs, model.pair_tables, strict=True):
        raw += t[min(bins[j] * 8 // len(model.tables[j]), 7)][min(bins[k] * 8 // len(model.tables[k]), 7)]
    return 1 / (1 + math.exp(-min(30, max(-30, raw))))


def slow_toxicity(net, text):
    """The network one window, one word and one unit at a time."""
    h = toxicity.SIZE
    words = toxicity.alnum_words(text)

    def vector(w):
        b = b"<" + w + b">"
        grams = [(b[i] * 7919 + b[i + 1] * 104729 + b[i + 2] * 1299709) % toxicity.GRAMS for i in range(len(w))]
        return net.p["word"][net.words.get(w, 0)].astype(float) + sum(net.p["gram"][g].astype(float) for g in grams) / len(grams)

    def states(xs, u):
        s, out = np.zeros(h), []
        for x in xs:
            x = x @ net.p[f"in_{u}"] + net.p[f"b_{u}"] if x is not None else net.p[f"b_{u}"].astype(float)
            rec = net.p[f"rec_{u}"].astype(float)
            z = [min(1, max(0, 0.25 * (x[i] + s @ rec[:, i]) + 0.5)) for i in range(h)]
            r = [min(1, max(0, 0.25 * (x[h + i] + s @ rec[:, h + i]) + 0.5)) for i in range(h)]
            c = [min(1, max(-1, x[2 * h + i] + (np.array(r) * s) @ rec[:, 2 * h + i])) for i in range(h)]
            s = np.array([s[i] + z[i] * (c[i] - s[i]) for i in range(h)])
            out.append(s)
        return out

    best, start = None, 0
    while start == 0 or start + toxicity.WIDTH - toxicity.STEP < len(words):
        xs = [vector(w) for w in words[start : start + toxicity.WIDTH]]
        xs += [None] * (toxicity.WIDTH - len(xs))
        both = [np.concatenate([f, b]) for f, b in zip(states(xs, "f"), states(xs[::-1], "b")[::-1], strict=True)]
        e = [float(v @ net.p["att"]) for v in both]
        a = [math.exp(v - max(e)) for v in e]
        pooled = sum(w * float(v @ net.p["out"]) for w, v in zip(a, both, strict=True)) / sum(a)
        raw = (pooled + float(net.p["out_b"][0])) * net.scale + net.shift
        best = raw if best is None else max(best, raw)
        start += toxicity.STEP
    return 1 / (1 + math.exp(-min(30, max(-30, best))))


def test_scores_equal_brute_force(spark):
    """Both models on the given documents, and on no documents and no labels."""
    d, known = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model, net = quality.train_quality(d, known), toxicity.train_toxicity(d, known)
    texts = {r["doc_id"]: r["text"] for r in d.collect()}
    for r in quality.score_quality(d, model).collect():
        assert abs(r["score"] - slow_quality(model, texts[r["doc_id"]])) < 1e-9
    some = [r for r in toxicity.score_toxicity(d, net).collect() if len(texts[r["doc_id"]] or "") < 1500]
    assert len(some) > 40
    for r in some[:80]:
        assert abs(r["score"] - slow_toxicity(net, texts[r["doc_id"]])) < 1e-3
    none = d.limit(0)
    assert quality.score_quality(none, model).count() == toxicity.score_toxicity(none, net).count() == toxicity.drop_toxic(none, net).count() == 0
    for docs_, labels_ in ((d, known.limit(0)), (none, known)):
        assert quality.score_quality(d, quality.train_quality(docs_, labels_)).count() == len(texts)
        assert toxicity.score_toxicity(d, toxicity.train_toxicity(docs_, labels_)).count() == len(texts)


def test_tree_step_equals_exhaustive_search():
    rng = np.random.default_rng(4)
    for _ in range(20):
        g, h = rng.normal(size=9), rng.random(9) + 0.1
        step, gain = quality.tree_step(g, h, 2, 2.0)
        whole = g.sum() ** 2 / (h.sum() + 2)
        best = max(range(1, 9), key=lambda s: g[:s].sum() ** 2 / (h[:s].sum() + 2) + g[s:].sum() ** 2 / (h[s:].sum() + 2))
        left, right = g[:best].sum() / (h[:best].sum() + 2), g[best:].sum() / (h[best:].sum() + 2)
        more = g[:best].sum() * left + g[best:].sum() * right - whole
        assert np.isclose(gain, max(more, 0), atol=1e-8)
        assert np.allclose(step, [left] * best + [right] * (9 - best) if more > 1e-9 else [g.sum() / (h.sum() + 2)] * 9)


def test_gradients():
    net = toxicity.fit_network(["a b bad", "a c", "b bad d", "d e"] * 6, np.array([1, 0, 1, 0] * 6), rounds=1)
    net.scale, net.shift = 1.0, 0.0
    w, y = [[b"a", b"bad", b"c"], [b"a", b"d"]], np.array([1.0, 0.0], np.float32)
    g = toxicity.gradients(net, w, y)

    def loss():
        words = [b"a", b"bad", b"c", b"d"]
        tables = [np.concatenate([net.p[f"b_{u}"][None], x]).astype(np.float32) for u, x in zip("fb", net.products(words), strict=True)]
        ids = np.zeros((2, toxicity.WIDTH), np.int64)
        ids[0, :3], ids[1, :2] = [1, 2, 3], [1, 4]
        z = net.logits(tables, ids).astype(float)
        return float(np.mean(np.log1p(np.exp(-z * (2 * y - 1)))))

    for name in ("out", "att"):  # these don't pass the clipped units, whose slope is softened
        for i in range(3):
            e = 1e-2
            net.p[name][i] += e
            up = loss()
            net.p[name][i] -= 2 * e
            down = loss()
            net.p[name][i] += e
            assert abs((up - down) / (2 * e) - g[name][i]) < 2e-3


# Urls ------------------------------------------------------------------------------------------------------------------------


def test_urls(spark):
    own = ["https://A.Example.com/en/71?x", "http://b.com/en/x", "http://b.net/de/8", "x://c.example.net/de/8#f", "http://o.org/es/1", "http://o.org/en/1", None, "nourl", "http://", "http://xcom/en/1", "ftp://h?q", "http://b.com/en"]
    d = spark.createDataFrame([(i, u, "h") for i, u in enumerate(own)], "page_id long, url string, host string")
    got = {r["page_id"]: r for r in urls.judge_urls(d.union(d)).collect()}  # repeated rows too
    assert len(got) == len(own)
    assert [got[i]["rule"] for i in range(5)] == ["example.com/en/7", "com/en/", "net/de/", "example.net/de/8", "org/es/"]
    assert [got[i]["verdict"] for i in range(6)] == ["allow", "block", "allow", "block", "block", "allow"]
    assert [(got[i]["host"], got[i]["path"]) for i in (0, 6, 7, 8, 9, 10)] == [("a.example.com", "/en/71"), ("", ""), ("", ""), ("", ""), ("xcom", "/en/1"), ("h", "")]
    assert got[9]["rule"] is None and got[11]["rule"] is None


def test_url_templates_learn_from_labels(spark):
    own = [f"http://h.site/bad/{i}" for i in range(40)] + [f"http://h.site/good/{i}" for i in range(40)] + ["http://h.site/bad/unseen1"]
    d = spark.createDataFrame(list(enumerate(own)), "page_id long, url string")
    rules = {f"h.site/bad/{i}": "block" for i in range(1, 4)} | {"h.site/good/": "allow"}
    got = {r["page_id"]: r["verdict"] for r in urls.judge_urls(d, rules).collect()}
    assert got[5] == "block" and got[45] == "allow"
    assert urls.judge_urls(d.limit(0)).count() == 0


def brute_verdicts(rows, rules, levels=8, many=12, rare=20, threshold=0.7, least=3, prior=0.2, strength=2.0, z=1.96):
    """page_id -> (host, path, rule, verdict, template), written as loops over a tree of dicts."""

    def general(s):
        s = re.sub(r"^\d{4}-\d\d?(-\d\d?)?(?=\.|$)", "{date}", s)
        s = re.sub(r"^\d+(?=\.|$)", "{n}", s)
        s = re.sub(r"^(?=[0-9a-f-]*\d)[0-9a-f]{8}[0-9a-f-]*(?=\.|$)", "{hex}", s)
        return re.sub(r"\d{3,}", "{n}", s)

    urls_, out = [], {}
    for i, url in rows:
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
        fit = [r for r in rules if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith("/" + r.split("/", 1)[1])]
        rule = max(fit, key=len, default=None)
        urls_.append([i, host, path, rule, [general(x) for x in path.split("/") if x], [host], rules.get(rule)])
    for level in range(levels):
        kinds = defaultdict(lambda: defaultdict(int))
        for u in urls_:
            if len(u[4]) > level:
                kinds[u[5][-1]][u[4][level]] += 1
        for u in urls_:
            if len(u[4]) > level:
                k, x = kinds[u[5][-1]], u[4][level]
                wild = len(k) > many and sum(k.values()) / len(k) < rare and k[x] < rare
                u[5] = [*u[5], f"{u[5][-1]}/{'*' if wild else x}"]
    for u in urls_:
        if len(u[4]) > levels:
            u[5] = [*u[5], u[5][-1] + "/" + "/".join(u[4][levels:])]
    node = defaultdict(lambda: [0, 0, 0, None])
    for u in urls_:
        for k, t in enumerate(u[5]):
            v = node[t]
            v[0], v[1], v[2], v[3] = v[0] + 1, v[1] + (u[6] is not None), v[2] + (u[6] == "block"), u[5][k - 1] if k else None
    at = {}
    for up in {v[3] for v in node.values()} - {None}:
        kids = {t: v for t, v in node.items() if v[3] == up}
        seen = [v for v in kids.values() if v[1]]
        pl, pb = sum(v[1] for v in seen), sum(v[2] for v in seen)
        like = {t for t, v in kids.items() if v[1] and abs(v[2] / v[1] - pb / pl) <= z * (max(pb / pl * (1 - pb / pl), 0.01) / v[1]) ** 0.5}
        for t, v in kids.items():
            at[t] = [sum(kids[x][1] for x in like), sum(kids[x][2] for x in like)] if t in like else v[1:3]
    for i, host, path, rule, _, nodes, said in urls_:
        v = node[host]
        unsaid = 0.5 * (v[0] - v[1]) + strength
        p = (v[2] + prior * unsaid) / (v[1] + unsaid)
        for t in nodes[1:]:
            p = (at[t][1] + strength * p) / (at[t][0] + strength)
        out[i] = host, path, rule, said or ("block" if v[1] >= least and p >= threshold else "allow"), nodes[-1]
    return out


def test_url_verdicts_equal_brute_force(spark):
    given = [(r["page_id"], r["url"]) for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "url").collect()]
    made = [f"http://h{i % 3}.com/{'en' if i % 7 else 'de'}/{i % 30}x{chr(97 + i % 26)}/{i}/a/b/c/d/e/f{i % 2}/g" for i in range(200)]
    rows = [*given, *[(10**6 + i, u) for i, u in enumerate([*made, *made[:5], None, "x", "http://h0.com"])]]
    d = spark.createDataFrame(rows, "page_id long, url string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"], r["template"]) for r in urls.judge_urls(d).collect()}
    want = brute_verdicts(rows, urls.RULES)
    assert got == want
    assert any(v[2] is None and v[3] == "block" for v in got.values())


# Near copies -----------------------------------------------------------------------------------------------------------------


def shingle_set(t, k):
    w = (t or "").encode().lower().split()
    return set() if not w else ({tuple(w)} if len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)})


def components(sets, percent):
    up = list(range(len(sets)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(range(len(sets)), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            x, y = top(a), top(b)
            up[max(x, y)] = min(x, y)
    return [top(i) for i in range(len(sets))]


@pytest.mark.parametrize(("words", "percent"), [(3, 90), (5, 80)])
def test_near_groups(spark, texts, words, percent):
    rng = random.Random(words)
    vocabulary, own = [f"w{i}" for i in range(2000)], list(texts)
    for _ in range(9):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([9, 15, 30, 60, 150]))]
        for _ in range(22):
            t = list(base)
            for _ in range(rng.randint(0, max(1, len(t) // 15))):
                t[rng.randrange(len(t))] = rng.choice(vocabulary)
            own.append(" ".join(t))
    rng.shuffle(own)
    sets = [shingle_set(t, words) for t in own]
    want = components(sets, percent)
    d = docs(spark, own)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near.near_groups(d, words, percent).collect()}
    assert got == {i: (len(sets[i]), want[i]) for i in range(len(own))}
    kept = near.drop_near(d.unionByName(docs(spark, ["x"]).withColumn("doc_id", F.lit(None).cast("long"))), words, percent)
    assert kept.columns == d.columns and {r["doc_id"] for r in kept.collect()} == {i for i in range(len(own)) if want[i] == i} | {None}


def test_drop_near_by_row(spark):
    """One row of each group stays, whatever ids its rows share or lack, and no other row goes with them."""
    a, b, c, e = (" ".join(f"{x}{i}" for i in range(40)) for x in "abce")
    rows = [(5, a + " z"), (3, a), (3, a), (3, a + " y"), (5, b), (None, c), (None, c), (None, c + " z"), (9, e), (None, e), (None, ""), (4, None), (4, None)]
    d = spark.createDataFrame([(i, t, k, 0) for k, (i, t) in enumerate(rows)], "doc_id long, text string, row int, doc int")
    kept = near.drop_near(d)
    assert kept.columns == d.columns
    got = [(r["doc_id"], r["text"], r["row"]) for r in kept.collect()]
    left = sorted(k for _, _, k in got)
    assert len([k for k in left if k in (0, 1, 2, 3)]) == 1 and len([k for k in left if k in (5, 6, 7)]) == 1
    assert set(left) - {1, 2, 3, 5, 6, 7} == {4, 8, 10, 11, 12} and all(rows[k] == (i, t) for i, t, k in got)
    many = spark.createDataFrame([(3, a)] * 20 + [(5, a + " z"), (5, b)], "doc_id long, text string")
    groups = near.near_groups(many).collect()
    assert len(groups) == 22 and {(r["doc_id"], r["component_id"]) for r in groups} == {(3, 3), (5, 3), (5, 5)}


def test_repeated_rows_are_compared_once(spark):
    a = " ".join(f"a{i}" for i in range(40))
    d = spark.createDataFrame([(3, a)] * 20 + [(5, a + " z")] * 20, "doc_id long, text string")
    sets = near.shingle_sets(d, 5)
    classes = sets.groupBy(F.col("h1").alias("node"), "h2", "n").agg(F.min("doc_id").alias("rep"))
    x, y = sorted(r["node"] for r in classes.collect())
    pairs = spark.createDataFrame([(x, y)], "a long, b long")
    assert near.verified(pairs, classes, d, 5, 80, True).count() == 1


def test_near_groups_of_nothing(spark):
    assert near.near_groups(docs(spark, [])).count() == 0


@pytest.mark.parametrize("percent", [80, 90])
def test_similar_sets_share_a_signature(percent):
    rng = np.random.default_rng(percent)
    for n in (1, 2, 5, 9, 12, 20, 33, 60, 130, 400, 1500):
        for _ in range(30):
            a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
            most = (100 - percent) * n // (100 + percent)
            out = int(rng.integers(0, most + 1))
            b = np.unique(np.concatenate([a[out:], rng.integers(0, 2**63, int(rng.integers(0, most - out + 1)), dtype=np.uint64)]))
            both = len(np.intersect1d(a, b))
            if 100 * both >= percent * (len(a) + len(b) - both):
                assert len(np.intersect1d(near.signatures(a, percent), near.signatures(b, percent)))


# Leaks -----------------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("most", [10**6, 0])
def test_leaks(spark, texts, most):
    rng = random.Random(6)
    vocabulary = [f"w{i}" for i in range(60)]
    items = [" ".join(rng.choice(vocabulary) for _ in range(rng.choice([1, 3, 9, 10, 11, 30]))) for _ in range(25)]
    items += [items[0], None, "", "Some-Longer, item: with MORE than ten words, and signs in it!"]
    own = list(texts)
    for _ in range(60):
        w = [rng.choice(vocabulary) for _ in range(rng.randint(0, 60))]
        if rng.random() < 0.5:
            w[rng.randint(0, len(w)) : 0] = (rng.choice(items) or "").split()[: rng.randint(8, 40)]
        own.append(" ".join(w))
    own.append("some longer item with more than ten words and signs in it")
    bench = spark.createDataFrame([(i, t, "q") for i, t in enumerate(items)] + [(3, items[3], "q")], "item_id long, text string, doc_id string")
    d = docs(spark, own)
    got = {r["doc_id"]: r for r in leaks.leak_digest(d, bench, most).collect()}
    windows = defaultdict(set)
    for i, t in enumerate(items):
        w = leaks.alnum_words(t)
        n = min(len(w), 10)
        for a in range(len(w) - n + 1 if w else 0):
            windows[tuple(w[a : a + n])].add(i)
    for i, t in enumerate(own):
        w = leaks.alnum_words(t)
        hit, found = [0] * len(w), set()
        for n in {len(k) for k in windows}:
            for a in range(len(w) - n + 1):
                if ids := windows.get(tuple(w[a : a + n])):
                    hit[a : a + n] = [1] * n
                    found |= ids
        sha = hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()
        r = got[i]
        assert (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) == (len(w), sum(hit), len(found), sha, bool(sum(hit)))
    kept = leaks.drop_leaks(d, bench, most)
    assert kept.columns == d.columns and {r["doc_id"] for r in kept.collect()} == {i for i in got if not got[i]["contaminated"]}
    assert leaks.leak_digest(d, bench.limit(0), most).filter("contaminated").count() == 0


@pytest.mark.parametrize("most", [10**6, 0])
def test_leaks_by_row(spark, most):
    """Rows that share an id, or have none, are each judged; an item without an id is found but not named."""
    bad, good = "one two three four five six seven eight nine ten", "nothing of that kind is in here"
    d = spark.createDataFrame([(None, bad, 1), (None, good, 2), (7, bad, 3), (7, good, 4), (8, good, 5), (8, good, 5)], "doc_id long, text string, row int")
    kept = leaks.drop_leaks(d, spark.createDataFrame([(1, bad)], "item_id long, text string"), most)
    assert kept.columns == d.columns and sorted(r["row"] for r in kept.collect()) == [2, 4, 5, 5]
    bench = spark.createDataFrame([(None, bad), (1, bad), (None, "kind")], "item_id long, text string")
    got = sorted((r["n_hit"], r["items"]) for r in leaks.find_leaks(d, bench, most).collect())
    assert got == [(1, [])] * 4 + [(10, ["1"])] * 2


# Pipeline --------------------------------------------------------------------------------------------------------------------


def test_pipeline(spark, tmp_path):
    import corpus_pipeline as P

    assert [n for n, _ in P.STAGES] == ["toxicity", "ngram_jaccard_join", "benchmark_decontamination", "pii", "best_fit_packing"]
    d = spark.read.parquet(f"{SF}/documents.parquet")
    names, before = d.columns, d
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    for k, (name, stage) in enumerate(P.STAGES):
        stage(spark, before, SF).write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        if k < 4:
            assert after.columns == names
        if name == "ngram_jaccard_join":
            rows = sorted((r["doc_id"], r["text"]) for r in before.collect())
            want = components([shingle_set(t, 5) for _, t in rows], 80)
            assert {r["doc_id"] for r in after.collect()} == {rows[i][0] for i in range(len(rows)) if want[i] == i}
        if name == "benchmark_decontamination":
            bad = {r["doc_id"] for r in leaks.leak_digest(before, bench).filter("contaminated").collect()}
            assert {r["doc_id"] for r in after.collect()} == {r["doc_id"] for r in before.collect()} - bad
        before = after
    check_packing(before.collect())


def test_pipeline_stages_on_odd_rows(spark):
    """Nulls, repeated rows, ties, empty and very long texts, clashing columns, and no rows at all."""
    import corpus_pipeline as P

    long_ = " ".join(f"word{i % 977}x{i}" for i in range(30_000))
    copies = "the same seven words stand in here"
    rows = [(1, copies), (1, copies), (None, copies), (2, None), (2, None), (3, ""), (None, None), (4, long_), (4, "quite another text under the same id"), (5, "write to a.b@example.org now")]
    kind = "doc_id long, text string, lang string, source string, n_chars long, row long, node long, sig long, score double, doc string, rep long"
    odd = spark.createDataFrame([(i, t, "en", None, len(t) if t else None, 1, 2, 3, 0.5, "d", 4) for i, t in rows], kind)
    for d, size in ((odd, [10, 8, 8, 8, 15]), (odd.limit(0), [0] * 5)):
        for (name, stage), n in zip(P.STAGES, size, strict=True):
            after = stage(spark, d, SF)
            if name != "best_fit_packing":
                assert after.columns == odd.columns, name
                got = after.collect()
                assert len(got) == n, (name, len(got))
                d = spark.createDataFrame(got, kind)
            else:
                got = after.collect()
                check_packing(got)
                assert (len({r["doc_id"] for r in got}) == 6) if n else not got
    assert all("a.b@example.org" not in (r["text"] or "") for r in pii.redact_pii(odd).collect())


def test_ratios_decide_on_the_given_pages():
    """With the threshold off every page changes; with `article` and `main` renamed the ratios still find the same text."""
    import pyarrow.parquet as pq

    found = pq.read_table(f"{SF}/pages.parquet")["html"].to_pylist()[:150]
    same = 0
    for x in found:
        whole = pages.main_text(x)
        renamed = re.sub(r"<(/?)(article|main)\b", r"<\1div", x)
        same += pages.main_text(renamed) == whole
        assert pages.main_text(x, share=0.0) != whole and pages.main_text(renamed, share=0.0) != pages.main_text(renamed)
    assert same >= 0.95 * len(found)


def test_marks_only_lower_the_score_of_article_text():
    page = (
        "<nav><a href=x>Home</a></nav><article><p>The market closed. It fell a lot today, sadly.</p><p class='share-price'>The share price rose by two, to ten. It may rise on.</p>"
        "<section class='related-work'><h2>Related work</h2><p>Others did this, too. We cite them here.</p></section><p>With <math><mi>x</mi></math> and <label>y</label>, done.</p>"
        "<div class='share'><a href=x>Share</a></div><div class='comments'><p>I like this, a lot. Really, I do.</p></div></article><footer>All rights, reserved.</footer>"
    )
    assert pages.main_text(page).split("\n") == ["The market closed. It fell a lot today, sadly.", "The share price rose by two, to ten. It may rise on.", "Related work", "Others did this, too. We cite them here.", "With x and y, done."]


def test_crowds_of_unlike_texts_with_a_common_line(spark):
    """Short texts with one line in common meet in its signatures; they are told apart, and the copies among them are found."""
    rng = random.Random(4)
    line = "this very long line stands in each and every one of the texts here"
    texts = [f"{line} {' '.join(f'w{rng.randrange(10**6)}' for _ in range(8))}" for _ in range(300)]
    texts += [f"{t} end" for t in texts[:20]] + [f"{t} end stop" for t in texts[:5]]
    got = {r["doc_id"]: r["component_id"] for r in near.near_groups(docs(spark, texts), words=5, percent=80).collect()}
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for t in texts)]
    top = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((top[a], top[b]))
                top = [x if t == y else t for t in top]
    assert got == dict(enumerate(top)) and len(set(top)) == 300


def test_few_classes_of_a_key_are_paired_and_crowds_left(spark):
    rows = [(k, n, n, 40, 0 if k else (1 << (n % 62)) - 1) for k in range(3) for n in range(5 if k else 20)] + [(7, 1, 1, 4, 0), (7, 2, 1, 4, 0)]
    df = spark.createDataFrame(rows, "hub long, node long, comp long, n long, fold long")
    pairs, crowd = near.told_apart(df, "hub", 80, most=16)
    assert sorted(map(tuple, pairs.collect())) == sorted([(a, b) for b in range(5) for a in range(b)] * 2)
    assert {r["hub"] for r in crowd.collect()} == {0}
    far, _ = near.told_apart(df.filter("hub = 0"), "hub", 80, most=20)
    want = [(a, b) for b in range(20) for a in range(b) if bin(((1 << b) - 1) ^ ((1 << a) - 1)).count("1") * 180 <= 20 * 80]
    assert sorted(map(tuple, far.collect())) == sorted(want)
