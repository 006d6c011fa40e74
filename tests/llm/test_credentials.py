import random
import re
from hashlib import sha256
from math import exp, log

from labspark.llm import credentials
from labspark.llm.automata import CLASSES, Automaton
from labspark.llm.queries import QUERIES
from tests.llm import brute

SF = "/root/testdata/sf0.01"
ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""  # noqa: E501


def plain_spans(text):
    text = text or ""
    found = [(m.start(), 0, m.end(), "assign") for m in re.finditer(ASSIGN, text) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end(), "hex") for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(found)


def base_text(text):
    return ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in plain_spans(text))


def test_query_holds_all_base_spans(spark):
    docs = brute.documents(SF)
    got = QUERIES["op4_secret_formats"](spark, SF).toPandas().sort_values("doc_id", ignore_index=True)
    assert got.doc_id.tolist() == docs.doc_id.tolist()
    for row, text in zip(got.itertuples(), docs.text):
        spans = plain_spans(text)
        assert [row.n_assign, row.n_access, row.n_hex] == [sum(s[3] == k for s in spans) for k in ("assign", "access", "hex")]
        assert row.base_sha256 == sha256(base_text(text).encode()).hexdigest()
        shown = row.spans.split(",") if row.spans else []
        assert ",".join(s for s in shown if not s.startswith("format")) == base_text(text)
    assert got.n_hex.sum() > 0 and got.n_assign.sum() > 0


def test_base_rules_on_hard_texts():
    pick = random.Random(4)
    parts = ["token", "TOKEN", "api_key", "ApiKey", "passwd", "password", "ſecret", "secret", "=", ":", " ", '"', "'", "abcdefgh", "AKIA",
             "AKIAABCDEFGHIJKL", "0123456789abcdef" * 2, "é", "\n", "x1.y2/z3=", "K"]
    for _ in range(3_000):
        text = "".join(pick.choice(parts) for _ in range(pick.randint(1, 12)))
        assert [(a, k, b) for a, k, b, _ in credentials.base_spans(text)] == [(a, k, b) for a, k, b, _ in plain_spans(text)]


def test_automata_learn_formats():
    """Keys of a fixed shape are told from ordinary words, and likelihoods sum to about one over short strings."""
    pick = random.Random(8)
    key = lambda: "".join(pick.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(24))
    word = lambda: "".join(pick.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(pick.randint(16, 30)))
    formats = credentials.Formats((Automaton([key() for _ in range(300)]),), Automaton([word() for _ in range(300)]))
    assert all(formats.is_secret(key()) for _ in range(100)) and not any(formats.is_secret(word()) for _ in range(100))
    loop = Automaton(["0" * n for n in range(6) for _ in range(2 ** (5 - n))])
    total = sum(exp(loop.log_likelihood("0" * n)) * len(CLASSES[0]) ** n for n in range(40))
    assert abs(total - 1) < 0.05
    assert not credentials.Formats((), None).is_secret("x" * 20)


def test_merging_keeps_frequencies():
    """One looping state: half of the strings end at each step."""
    pick = random.Random(1)

    def draw():
        n = 0
        while pick.random() < 0.5:
            n += 1
        return "a" * n

    automaton = Automaton([draw() for _ in range(4_000)])
    assert len(automaton.states) == 1
    assert abs(automaton.log_likelihood("aaa") - log(0.5**4 / 6**3)) < 0.2


def test_formats_are_added_to_base_spans(spark):
    pick = random.Random(2)
    secret = lambda: "".join(pick.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(20))
    rows = [(i, f"some usual words and thensomeratherlongwordas{i % 7} api_key = {secret()} more", 1) for i in range(60)]
    bare = secret()
    rows += [(100, f"here {bare} stands alone", 1), (101, None, 1), (102, "", 1), (None, "secret: abcdefgh", 1), (100, f"here {bare} stands alone", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kind int")
    got = credentials.scan(docs, credentials.learn(docs)).collect()
    assert len(got) == 65
    alone = [r for r in got if r.doc_id == 100]
    assert len(alone) == 2 and all([(s.start, s.kind, s.end) for s in r.spans] == [(5, "format", 25)] for r in alone)
    assert all(r.n_format == 0 for r in got if r.doc_id != 100)
    assert [(r.n_assign, r.spans[0].start) for r in got if r.doc_id is None] == [(1, 0)]
    none = docs.limit(0)
    assert credentials.scan(none, credentials.learn(none)).count() == 0
