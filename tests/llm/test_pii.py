import hashlib
import math
import random
import re
import time

from data import DOCS, docs

from tabeval.llm import pii
from tabeval.llm.queries import op3_pii

#: the base patterns as they are specified
PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        x = int(c) * (1 + k % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def brute(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")),
                    "card": 16 <= len(d) <= 19 and luhn(d), "phone": 8 <= len(d) <= 15}[kind]:
                out.append((kind, m.start(), m.end()))
    return out


def check(rows, texts):
    for r in rows:
        found = brute(texts[r.doc_id])
        base = ",".join(f"{k}:{a}:{b}" for k, a, b in found)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == kind for k, _, _ in found) for kind in PLAIN)
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert r.spans == base or r.spans.startswith(base + "," if base else "term:")


def test_base_spans_are_those_of_the_plain_patterns(spark):
    pick = random.Random(11)
    texts = ["".join(pick.choice("aB1 2.3-@+()é,%4567890\n🙂") for _ in range(pick.randint(0, 50))) for _ in range(1500)]
    texts += ["a@b.co@d.e c_x@y.z a@b.c_x@y.z", "1.2.3.4.5.6.7.8 300.1.1.1 001.02.3.255", "4111 1111 1111 1111 4111-1111-1111-1111",
              "9" * 20_000, "1 " * 15_000, "a.b@" * 2000, "+1 (386) 555-3733", None, ""]
    rows = pii.digests(docs(spark, list(enumerate(texts)), False)).collect()
    assert len(rows) == len(texts)
    check(rows, dict(enumerate(texts)))


FILLER = "people wrote many letters about the weather and the people liked the weather a lot"


def wilson(n, of, z=1.0):
    p = n / of
    return (p + z * z / (2 * of) - z * math.sqrt(p * (1 - p) / of + z * z / (4 * of * of))) / (1 + z * z / of)


def words(text):
    """Words in lower case with their places, outside base spans."""
    rest = list(text)
    for _, a, b in brute(text):
        rest[a:b] = " " * (b - a)
    return [(m[0].lower(), m.start(), m.end()) for m in re.finditer(r"[^\W_]+(?:['\u2019][^\W_]+)*", "".join(rest))]


def protected(text):
    out = set()
    for kind, a, b in brute(text):
        v = text[a:b]
        d = re.sub("[^0-9]", "", v)
        out |= {f"{kind}:{v}", f"{kind}/" + {"email": v.split("@")[-1].lower(), "ip": v.rsplit(".", 1)[0], "card": d[:6], "phone": d[:6]}[kind]}
    return out


def plain_terms(texts):
    """The disclosing terms by loops over the different texts: term, letters that stay."""
    texts = [t or "" for t in dict.fromkeys(t or "" for t in texts)]
    terms, held = [{w for w, _, _ in words(t)} for t in texts], [protected(t) for t in texts]
    n_term, n_first, hidden, size = {}, {}, {}, {}
    for own in terms:
        for t in own:
            n_term[t] = n_term.get(t, 0) + 1
        for c in {t[:k] for t in own for k in pii.CLASSES}:
            n_first[c] = n_first.get(c, 0) + 1
    for e in set().union(*held) if held else ():
        inside = [own for own, es in zip(terms, held) if e in es]
        if len(inside) == len(texts):
            continue
        for t in set().union(*inside):
            both = sum(t in own for own in inside)
            h = -math.log2(wilson(both, n_term[t]))
            if n_term[t] <= 2 * len(inside) and h <= pii.HIDDEN_BITS + 1e-12:
                hidden[t], size[t] = min(h, hidden.get(t, 9)), max(len(inside), size.get(t, 0))
    out = {}
    for t, h in hidden.items():
        kept = [k for k in pii.CLASSES if len(t) > k and n_first[t[:k]] > 2 * size[t]]
        out[t] = 0 if h <= pii.REMOVED_BITS else max(kept, default=0)
    return out


def found_terms(df):
    return {r.term: r.letters for r in pii.disclosing_terms(pii.find(df, ["doc_id"])).collect()}


def test_terms_and_places_against_loops(spark):
    pick = random.Random(3)
    vocabulary = [f"{a}{b}" for a in ("ka", "lo", "mi", "Nu", "o'", "pé") for b in range(40)]
    mails = ["a@x.org", "b@x.org", "c@y.org", "10.0.0.1", "10.0.0.9", "+1 555 123 4567"]
    texts = []
    for k in range(300):
        body = [pick.choice(vocabulary[: 1 + int(len(vocabulary) * pick.random() ** 3)]) for _ in range(pick.randint(0, 12))]
        if k % 4 == 0:
            e = pick.randrange(len(mails))
            body += [mails[e], f"owner{e}", f"rare{k}"] + ([mails[pick.randrange(6)]] if k % 8 else [])
        texts.append(" ".join(body))
    texts += ["owner0 wrote", "owner1 and lo3", texts[8], texts[8], None, ""]
    df = docs(spark, list(enumerate(texts)), False)
    expected = plain_terms(texts)
    assert found_terms(df) == expected and any(expected.values()) and 0 in expected.values()
    rows = pii.digests(df).collect()
    check(rows, dict(enumerate(texts)))
    for r in rows:
        places = [f"term:{a}:{b}" for w, a, b in words(texts[r.doc_id] or "") if w in expected]
        assert [s for s in r.spans.split(",") if s[:5] == "term:"] == places and r.n_term == len(places)


def test_owners_shared_domain_is_evidence(spark):
    """Each address stands in one text; the domain tells that the firm's name discloses it, wherever it stands."""
    texts = [f"{FILLER} {k} staff{k}@zorblax.com the zorblax" for k in range(12)] + [f"{FILLER} the zorblax"] + [f"{FILLER} z{k}" for k in range(60)]
    df = docs(spark, list(enumerate(texts)), False)
    terms = found_terms(df)
    assert terms["zorblax"] == 1 and not {"people", "weather", "the"} & set(terms)  # many words begin with z
    clean = {r.doc_id: r.text for r in pii.sanitise(df).collect()}
    assert clean[12] == f"{FILLER} the z\u2026"
    assert all(clean[k].endswith("[EMAIL] the z\u2026") for k in range(12)) and all(clean[k] == texts[k] for k in range(13, 73))


def test_few_texts_are_weak_evidence(spark):
    """A word of two texts, one of which holds the entity, tells too little of it; a word of one text is generalised."""
    texts = [f"{FILLER} {k}" for k in range(60)] + [f"{FILLER} spy@example.com zorblax letterhead", f"{FILLER} zorblax"]
    terms = found_terms(docs(spark, list(enumerate(texts)), False))
    assert terms == {"letterhead": 3}  # the first letters of ``letters``
    many = [f"{FILLER} {k} spy@example.com quux" for k in range(20)] + texts
    assert found_terms(docs(spark, list(enumerate(many)), False))["quux"] == 0  # hides next to nothing: removed


def test_a_list_of_contacts_is_one_group(spark):
    """Entities of the same texts are judged together: pairs grow with the words, not words times entities."""
    text = " ".join(f"name{k} x{k}@h{k}.org" for k in range(3000))
    df = docs(spark, [(0, text), (1, text + " more"), *((k, f"{FILLER} {k}") for k in range(2, 30))], False)
    held = pii.holders(pii.different(pii.find(df, ["doc_id"]))[0])
    assert {r.n for r in held.select(pii.F.size("_groups").alias("n")).collect()} == {1}
    assert {r.doc_id: r.n_email for r in pii.digests(df).collect() if r.n_email} == {0: 3000, 1: 3000}
    assert pii.sanitise(df).where("text like '%@%'").count() == 0


def test_long_texts_take_time_in_proportion(spark):
    def seconds(n):
        df = docs(spark, [(0, " ".join(f"w{k} u{k}@h.org" for k in range(n))), (1, FILLER)], False)
        start = time.time()
        assert "@" not in pii.sanitise(df).where("doc_id = 0").first().text
        return time.time() - start
    seconds(100)
    assert seconds(20_000) < 25


def test_awkward_rows(spark):
    rows = pii.digests(docs(spark)).collect()
    assert len(rows) == len(DOCS)
    assert sorted((r.n_email, r.n_ip) for r in rows if r.doc_id is None) == [(0, 0), (1, 1)]
    clean = pii.sanitise(docs(spark))
    assert clean.columns == docs(spark).columns and clean.count() == len(DOCS)
    clash = docs(spark).withColumns({c: pii.F.lit("other") for c in ("_key", "_cuts", "text_key", "_text_key", "doc")})
    assert all(r["_cuts"] == r["_text_key"] == "other" for r in pii.sanitise(clash).collect())
    assert sum(r.text is None for r in clean.collect()) == 2
    assert pii.digests(docs(spark).where("false")).count() == 0


def test_no_python_in_the_plan(spark):
    plan = pii.digests(docs(spark))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|InArrow", plan)


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    check(op3_pii(spark, sf).collect(), dict(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()))
