"""Personal data and secrets against plain patterns; what the methods add."""

import hashlib
import random
import re
import time

import numpy as np
import pyarrow as pa
from samples import clashing, frame, prose

from trailworks.llm import personal_data as personal
from trailworks.llm.personal_data import KINDS, Field, Graph, graph, learn, luhn, pattern_spans, personal_data, redacted, train
from trailworks.llm.secrets import BASE_RULES, MORE_RULES, candidates, find_secrets, secret_report, trigram_query

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_spans(text):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out = [(0, *m.span()) for m in EMAIL.finditer(text)]
    out += [(1, *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(2, *m.span()) for m in CARD.finditer(text) if 16 <= len(digits(m)) <= 19 and luhn(digits(m))]
    return out + [(3, *m.span()) for m in PHONE.finditer(text) if 8 <= len(digits(m)) <= 15]


def mixed(rng, parts, n=25):
    return "".join(rng.choice(parts) for _ in range(rng.randrange(n)))


def test_patterns_equal_plain_search():
    rng = random.Random(1)
    parts = ["a", "b.", "@", "1", "23", ".", "..", "-", " ", "+", "(5)", "é", "4111111111111111", "4012888888881881", "_", "%", "\n"]
    for _ in range(20_000):
        text = mixed(rng, parts)
        assert pattern_spans(text) == plain_spans(text), text


def test_patterns_are_fast_on_long_runs():
    for text in ("a" * 200_000 + "@", "1" * 200_000, "1." * 100_000, "+1" + "(" * 200_000, "1 " * 100_000 + "@b.c"):
        pattern_spans(text)


def personal_texts():
    rng = random.Random(2)
    out = [None, "", "no data here", "no data here", "é😀 mail a.b@c.de now", "x " * 20_000 + "a@b.cd"]
    for k in range(150):
        kind = rng.choice([f"u{k}@mail{k}.example.com", f"{k % 250}.2.3.{k % 200}", "4111 1111 1111 1111", f"+1 (555) {rng.randrange(200, 999)}-{rng.randrange(1000, 9999)}"])
        out.append(f"{prose(rng, 8)} {kind} {prose(rng, 8)} {k} items in 2019")
    return out


def test_personal_data_keeps_all_pattern_spans(spark):
    texts = personal_texts()
    docs = clashing(frame(spark, texts))
    rows = {r.doc_id: r for r in personal_data(docs).collect()}
    assert len(rows) == len(texts)
    for k, t in enumerate(texts):
        base = sorted(plain_spans(t or ""))
        own = ",".join(f"{KINDS[a]}:{b}:{c}" for a, b, c in base)
        r = rows[k]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == q for s in base) for q in range(4)]
        assert r.base_sha256 == hashlib.sha256(own.encode()).hexdigest()
        assert set(filter(None, own.split(","))) <= set(filter(None, r.spans.split(",")))
        if not re.search("[0-9@]", t or ""):
            assert r.spans == ""
    assert personal_data(frame(spark, [])).count() == 0
    hidden = redacted(docs)
    assert hidden.columns == docs.columns
    for r in hidden.collect():
        assert (r.text is None) == (texts[r.doc_id] is None)
        assert not plain_spans(re.sub(r"\[(EMAIL|IP|CARD|PHONE)\]", " ", r.text or ""))


def test_skip_edges_carry_a_label_to_a_distant_repeat():
    """A word whose own evidence is weak takes the label of its repeat."""
    rng = np.random.default_rng(0)
    graphs = []
    for _ in range(300):        # feature 1: clearly a card; 2: clearly not; 3: says nothing
        card = rng.random() < 0.5
        graphs.append((Graph(np.zeros(2, int), np.zeros(2, int), np.ones(2, int), np.array([[1 if card else 2], [3]]), np.zeros((0, 2), int), np.array([[0, 1]])),
                       np.full(2, 3 if card else 0)))
    field = learn(graphs)
    for first, label in ((1, 3), (2, 0)):
        g = Graph(np.zeros(2, int), np.zeros(2, int), np.ones(2, int), np.array([[first], [3]]), np.zeros((0, 2), int), np.array([[0, 1]]))
        assert field.marginals(g).argmax(1).tolist() == [label, label]


def test_message_passing_is_exact_on_a_chain():
    rng = np.random.default_rng(3)
    field = Field(rng.normal(size=(8, 5)), rng.normal(size=(5, 5)), rng.normal(size=(5, 5)))
    g = Graph(np.zeros(3, int), np.arange(3), np.arange(3) + 1, np.array([[0], [1], [2]]), np.array([[0, 1]]), np.array([[1, 2]]))
    joint = np.exp(field.unary[0][:, None, None] + field.unary[1][None, :, None] + field.unary[2][None, None, :]
                   + field.chain[:, :, None] + field.skip[None, :, :])
    joint /= joint.sum()
    want = np.stack([joint.sum((1, 2)), joint.sum((0, 2)), joint.sum((0, 1))])
    assert np.allclose(field.marginals(g), want, atol=5e-3)


def test_evidence_travels_along_all_repeats_of_a_word():
    n = 60
    field = Field(np.array([[0.0] * 5, [0, 0, 0, 4.0, 0]]), np.zeros((5, 5)), 8 * np.eye(5))
    g = Graph(np.zeros(n, int), np.arange(n), np.arange(n) + 1, np.array([[1]] + [[0]] * (n - 1)), np.zeros((0, 2), int), np.stack([np.arange(n - 1), np.arange(1, n)], 1))
    want = [np.exp(field.unary[1]) / np.exp(field.unary[1]).sum()]      # nothing comes back from the others
    step = np.exp(field.skip) / np.exp(field.skip).sum(1)
    for _ in range(n - 1):
        want.append(want[-1] @ step)
    assert np.allclose(field.marginals(g), want, atol=5e-3)
    assert (field.marginals(g).argmax(1) == 3).all()


def test_long_numeric_texts_take_seconds():
    text = " ".join(str(10**9 + 7919 * k % 10**9) for k in range(100_000))       # 1.1 MB of ten-digit numbers
    field = Field(np.random.default_rng(0).normal(size=(1 << 13, 5)), 0.1 * np.eye(5), 0.1 * np.eye(5))
    start = time.process_time()
    g = graph(pa.RecordBatch.from_arrays([pa.array([1]), pa.array([text])], names=["doc_id", "text"]))
    assert len(g.row) == 100_000 and g.features.nbytes <= 28 * 100_000
    assert time.process_time() - start < 6


def test_messages_in_parts_equal_messages_at_once(monkeypatch):
    rng = np.random.default_rng(5)
    field = Field(rng.normal(size=(50, 5)), rng.normal(size=(5, 5)), rng.normal(size=(5, 5)))
    n = 200
    g = Graph(np.zeros(n, int), np.arange(n), np.arange(n) + 1, rng.integers(0, 50, (n, 3)), np.stack([np.arange(n - 1), np.arange(1, n)], 1)[rng.random(n - 1) < 0.6],
              np.array([[k, k + 7] for k in range(0, 190, 9)]))
    whole = field.marginals(g)
    monkeypatch.setattr(personal, "_MESSAGES", 17)
    assert np.array_equal(field.marginals(g), whole)


def test_training_without_any_entity(spark):
    field = train(frame(spark, ["no data", None]))
    assert personal_data(frame(spark, ["a 1 b 22"]), field).first().spans == ""


ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
PLAIN = [("assign", ASSIGN, 2, 6), ("access", re.compile("AKIA[A-Z0-9]+"), 0, 20), ("hex", re.compile("[0-9a-f]+"), 0, 24)]


def plain_secrets(text):
    found = [(m.start(), k, m.end()) for k, (_, p, g, n) in enumerate(PLAIN) for m in p.finditer(text) if len(m[g]) >= n]
    return sorted(found)


def secret_texts():
    rng = random.Random(4)
    parts = ["token", "PassWord", "api_key", "apikey", "secret", "=", ":", " ", '"', "'", "abc", "é", "😀", "AKIA", "ABCDEFGH12345678", "deadbeef", "0123456789abcdef", "f", ".", "\n"]
    texts = [None, "", "nothing", "nothing", "K" * 5, "toKen = abcdefgh", "token=token=abcdefg", "secret:tokena", "x" * 50_000 + "token=abcdefgh",
             ("token=" + "a" * 8 + " ") * 300, "-----BEGIN RSA PRIVATE KEY-----", "ghp_" + "a1" * 18, "xoxb-" + "a" * 12, "AIza" + "b" * 35]
    return texts + [mixed(rng, parts) for _ in range(400)]


def test_secrets_equal_plain_search(spark):
    texts = secret_texts()
    rows = {r.doc_id: r for r in secret_report(clashing(frame(spark, texts))).collect()}
    assert len(rows) == len(texts)
    for k, t in enumerate(texts):
        found = plain_secrets(t or "")
        own = ",".join(f"{PLAIN[q][0]}:{a}:{b}" for a, q, b in found)
        r = rows[k]
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(f[1] == q for f in found) for q in range(3)], t
        assert r.base_sha256 == hashlib.sha256(own.encode()).hexdigest()
        assert set(filter(None, own.split(","))) <= set(r.spans.split(","))
    assert [rows[k].spans.split(":")[0] for k in (10, 11, 12, 13)] == ["private_key", "forge_token", "chat_token", "cloud_key"]
    assert secret_report(frame(spark, [])).count() == 0


def test_secrets_of_odd_rows(spark):
    text = "my token = abcdef"
    assert [len(r.found) for r in find_secrets(frame(spark, [(None, text), (4, text), (4, text)])).collect()] == [1, 1, 1]


def test_index_loses_no_match(spark):
    texts = secret_texts()
    got = {r.doc_id: set(r.rules) for r in candidates(frame(spark, texts), BASE_RULES + MORE_RULES).collect()}
    for k, t in enumerate(texts):
        for _, rule, _ in plain_secrets(t or ""):
            assert rule == 2 or rule in got[k]
    assert trigram_query(r"[0-9a-f]{24,}") == []
    assert trigram_query("AKIA[A-Z0-9]+") == [frozenset({"aki", "kia"})]
    assert trigram_query("ab(cd|ef)?gh") == []
    assert trigram_query("abc(de|f)g") == [frozenset({"abc", "bcd", "cde", "deg"}), frozenset({"abc", "bcf", "cfg"})]
