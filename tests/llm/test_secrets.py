import hashlib
import random
import re
import time

from govlens.llm import secrets

ASSIGN = re.compile(
    r"(?:(?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
ACCESS, HEX = re.compile(r"AKIA[A-Z0-9]+"), re.compile(r"[0-9a-f]+")


def base(text):
    """Base spans by the definition, one kind after the other."""
    text = text or ""
    out = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
    out += [(m.start(), 1, "access", m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    out += [(m.start(), 2, "hex", m.end()) for m in HEX.finditer(text) if len(m[0]) >= 24]
    return sorted(out)


KEY = "AKIA" + "Z9" * 10
HEXES = "0123456789abcdef" * 2
TEXTS = [
    f"é token = '{HEXES}' and 😀 API_KEY:abc password: token: abcdefgh {KEY}",
    "Secret=short secret=longer.enough PASSWD\"  =  \"x/y+z==\" apikey=a",
    f"{KEY}AKIA{HEXES}{HEXES}z token=token=token",
    "AKIA123 deadbeef " + "f" * 23,
    "",
    None,
    f"token = {HEXES}",
    "-----BEGIN RSA PRIVATE KEY-----\nMIIabc+/=\nxyz\n-----END ghp_" + "a1" * 12,
]


def test_base_spans_against_the_definition(documents):
    rows = secrets.report(documents(list(enumerate(TEXTS)))).collect()
    assert len(rows) == len(TEXTS)
    for row in rows:
        want = base(TEXTS[row["doc_id"]])
        joined = ",".join(f"{kind}:{start}:{end}" for start, _, kind, end in want)
        assert row["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest(), row
        counts = [sum(w[2] == k for w in want) for k in ("assign", "access", "hex")]
        assert [row["n_assign"], row["n_access"], row["n_hex"]] == counts
        assert set(filter(None, joined.split(","))) <= set(row["spans"].split(","))
    extra = {r["doc_id"]: r["spans"] for r in rows}[7]
    assert "private:0:" in extra and "vendor:" in extra


def test_widely_copied_values_are_examples(documents):
    example, own = f"token = {HEXES}", f"token = {HEXES[::-1]}"
    rows = [(k, example, "en", f"s{k}") for k in range(4)] + [(k, own, "en", "s9") for k in (7, 8, 8)]
    rows += [(20, own, "en", None), (None, "nothing", "en", "s1")]
    found = {(r["doc_id"], r["n_live"], r["n_example"]) for r in secrets.report(documents(rows)).collect()}
    # assign and hex find the same value
    assert found == {(k, 0, 2) for k in range(4)} | {(7, 2, 0), (8, 2, 0), (20, 2, 0), (None, 0, 0)}


def test_redaction_leaves_examples_and_clean_texts(documents):
    example, own = f"a token = {HEXES} z", f"é token = {HEXES[::-1]} mid {KEY} end"
    rows = [(k, example, "en", f"s{k}") for k in range(4)] + [(9, own), (9, own), (10, "clean"), (11, None)]
    kept = secrets.redact(documents(rows)).collect()
    texts = sorted(((r["doc_id"], r["text"], r["n_chars"]) for r in kept), key=str)
    done = "é [secret:assign] mid [secret:access] end"
    want = [(k, example, len(example)) for k in range(4)] + [(9, done, len(done))] * 2
    assert texts == sorted([*want, (10, "clean", 5), (11, None, None)], key=str)
    assert kept[0].asDict()["source"] is not None and "node" in kept[0].asDict()


def test_empty_table(documents):
    assert secrets.report(documents([])).count() == 0
    assert secrets.redact(documents([])).count() == 0


def test_two_owners_in_many_repositories_are_an_example(documents):
    value = f"token = {HEXES}"
    many = [(k, value, "en", f"s{k % 2}") for k in range(8)]
    rows = secrets.report(documents(many)).collect()
    assert {(r["n_live"], r["n_example"], r["max_owners"], r["max_repos"]) for r in rows} == {(0, 2, 2, 8)}
    rows = secrets.report(documents(many[:7])).collect()
    assert {(r["n_live"], r["max_owners"], r["max_repos"]) for r in rows} == {(2, 2, 7)}
    alone = [(k, value, "en", "s0") for k in range(30)]
    assert {r["n_live"] for r in secrets.report(documents(alone)).collect()} == {2}


def replaced(text, spans):
    out, at = "", 0
    for start, kind, end in spans:
        if start >= at:
            out += text[at:start] + f"[secret:{kind}]"
        at = max(at, end)
    return out + text[at:]


def test_many_matches_in_one_text(documents):
    rng = random.Random(2)
    parts = [
        rng.choice(["é ", "\n", "😀 x "]) + rng.choice(["token=", "", "AKIA", "key: "]) + f"{rng.getrandbits(128):032x}"
        for _ in range(3000)
    ]
    text = "".join(parts)
    many = "".join(f"{k:024x} " for k in range(100_000))
    begin = time.perf_counter()
    found = {r["doc_id"]: r["spans"] for r in secrets.report(documents([(1, text), (2, many)])).collect()}
    assert found[2] == ",".join(f"hex:{25 * k}:{25 * k + 24}" for k in range(100_000))
    kept = {r["doc_id"]: r["text"] for r in secrets.redact(documents([(1, text), (2, many)])).collect()}
    assert kept[2] == "[secret:hex] " * 100_000
    assert time.perf_counter() - begin < 300
    spans = [s.split(":") for s in found[1].split(",")]
    want = [f"{kind}:{start}:{end}" for start, _, kind, end in base(text)]
    assert [":".join(s) for s in spans if s[0] in ("assign", "access", "hex")] == want
    assert kept[1] == replaced(text, [(int(start), kind, int(end)) for kind, start, end in spans])
