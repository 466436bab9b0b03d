import numpy as np
import pytest

from gaugeworks.llm.pii import WEIGHTS, find_spans, redact, redacted, settle, spans_in
from gaugeworks.llm.pii_rules import KINDS, NameForms, snap, weak_labels
from gaugeworks.llm.tagger import Tagger

TAGGER = Tagger.load(WEIGHTS)
TEXT = (
    "The fees payable under Schedule C amount to $28,802. Contact: zorette.varnley@example.org or (617) 555-0104. SSN 925-35-9577. "
    "The premises lie at 919 Bramble Ave., Apt 4B, Castrel, IL 00244. Dr. Lumika Grisley's deposition was adjourned. Ref. 5020569476/04. "
    "No waiver of Section 2.6 binds Varnacre Media S.A. unless a material instrument says so."
)
WANT = [("zorette.varnley@example.org", "email"), ("(617) 555-0104", "phone"), ("925-35-9577", "id_number"), ("919 Bramble Ave., Apt 4B, Castrel, IL 00244", "address"), ("Lumika Grisley", "name")]


def test_finds_and_leaves_the_rest():
    spans = spans_in([TEXT], TAGGER)[0]
    assert [(TEXT[b:e], k) for b, e, k in spans] == WANT
    out = redacted(TEXT, spans)
    assert "[EMAIL] or [PHONE]. SSN [ID_NUMBER]." in out and "Dr. [NAME]'s deposition" in out and "$28,802" in out and "Varnacre Media" in out


def test_long_texts_are_windowed():
    filler = "Force majeure includes flood, quarantine and the closure of the port of Pallara. "
    text = filler * 40 + TEXT + " " + filler * 40
    assert [(text[b:e], k) for b, e, k in spans_in([text], TAGGER)[0]] == WANT
    assert spans_in(["", " ", "x" * 5000], TAGGER) == [[], [], []]


def test_adjoining_names():
    text = "Saelena Lindley Lummiel Ruthmont-Varnovitz (00 976"
    assert [text[b:e] for b, e in snap(text, 0, 42, "name")] == ["Saelena Lindley", "Lummiel Ruthmont-Varnovitz"]
    assert snap("Invoice no. 555-123-4567 was", 12, 24, "phone") == []


def test_name_forms_generalise():
    forms = NameForms([(a + b, "given") for a in ("Bex", "Lum", "Kas", "Tav") for b in ("ado", "ika")] + [("Nyrado", "given"), ("Varnley", "surname"), ("Varnelle", "surname"), ("Oskelle", "surname"), ("Oskley", "surname")])
    assert [t for t in weak_labels("Attn: Nyrika Varnley", forms)] == [(6, 20, "name")]
    assert weak_labels("Varnley Foods Ltd", forms) == []


def test_gradients():
    tagger = Tagger.fresh(4, 2)
    tagger.w = {k: v.astype(np.float64) for k, v in tagger.w.items()}
    rng = np.random.default_rng(0)
    x, y = rng.integers(1, 20, (7, 2)).astype(np.int16), np.zeros((7, 2), np.int8)
    x[5:, 1] = 0
    y[2, 0], y[3, 0] = 1, 2
    _, g = tagger.loss(x, y)
    for k, w in tagger.w.items():
        at = (int(x[1, 0]), 3) if k.startswith("wx") else tuple(0 for _ in w.shape) if k != "trans" else (1, 2)
        old, step = w[at], 1e-2
        w[at] = old + step
        up = tagger.loss(x, y)[0]
        w[at] = old - step
        down = tagger.loss(x, y)[0]
        w[at] = old
        assert g[k][at] == pytest.approx((up - down) / (2 * step), abs=1e-4)


def test_frame(spark):
    df = spark.createDataFrame([(1, TEXT), (2, None), (3, ""), (4, TEXT), (4, TEXT)], "doc_id bigint, text string")
    got = find_spans(df, "doc_id", "text").collect()
    assert len(got) == 15 and {r.doc_id for r in got} == {1, 4}
    out = {r.doc_id: r.text for r in redact(df, "doc_id", "text").collect()}
    assert out[2] is None and out[3] == "" and "[ADDRESS]" in out[1]
    assert find_spans(df.limit(0), "doc_id", "text").count() == 0


def test_span_at_a_core_edge_stays():
    """The left window begins a name behind the cut at 320, the right one before it."""
    text = "z " * 159 + "Mr Lumika Grisley said " + "z " * 180

    class Split:
        gate = None

        def decode_scored(self, x):
            tags, name = np.zeros(x.shape, np.int8), 2 * KINDS.index("name") + 1
            for c in range(x.shape[1]):
                left = (x[:, c] > 0).sum() == 416
                begin, end = (321, 335) if left else (318 - 288, 335 - 288)
                tags[begin, c], tags[begin + 1 : end, c] = name, name + 1
            return tags, np.ones(x.shape)

    assert [(text[b:e], k) for b, e, k in spans_in([text], Split())[0]] == [("Lumika Grisley", "name")]


def test_short_long_and_several_single_names():
    names = lambda text, span: [text[b:e] for b, e in snap(text, text.index(span), text.index(span) + len(span), "name")]
    assert names("seen by Dr. Ng today", "Ng") == names("seen by Dr. Ng today", "Dr. Ng") == ["Ng"]
    assert names("item Ng today", "Ng") == names("the form. Ng today", "Ng") == []
    long = "Wolfeschlegelsteinhausenbergerdorff " + "Ruthmont-Varnovitz-Grisley-Oskelle"
    assert len(long) > 60 and names(f"by {long} here", long) == [long]
    assert names("by Grisley/Varnley; Oskelle here", "Grisley/Varnley; Oskelle") == ["Grisley", "Varnley", "Oskelle"]
    assert names("by Grisley/B here", "Grisley/B") == ["Grisley"]


def test_settling_against_all_sets():
    import itertools
    import random

    rng = random.Random(4)
    for _ in range(60):
        spans = {(b := rng.randrange(20), b + rng.randint(1, 6), "name"): rng.random() for _ in range(rng.randint(0, 8))}
        apart = lambda c: all(x[1] <= y[0] or y[1] <= x[0] for x, y in itertools.combinations(c, 2))
        most = max(sum(spans[s] for s in c) for n in range(len(spans) + 1) for c in itertools.combinations(spans, n) if apart(c))
        got = settle(spans)
        assert got == sorted(got) and apart(got) and abs(sum(spans[s] for s in got) - most) < 1e-9


def test_first_stage_scores_by_brute_force():
    from gaugeworks.llm import gate

    rng = np.random.default_rng(2)
    own = gate.Gate(*(rng.normal(size=gate.TABLE).astype(np.float32) for _ in range(3)), 0.25, 1.0)
    x = rng.integers(1, 104, 60).astype(np.int16)
    h = gate._hashes(x)
    for i, got in enumerate(own.scores(x)):
        before, after = own.before[h[max(0, i - gate.REACH) : i]].sum() / gate.REACH, own.after[h[i + 1 : i + 1 + gate.REACH]].sum() / gate.REACH
        assert got == pytest.approx(own.here[h[i]] + before + after + 0.25, abs=1e-4)
    hot = own.scores(x) > 1
    covered = np.zeros(60, bool)
    for s, e in own.parts(x):
        covered[s:e] = True
    assert covered[hot].all() and own.parts(np.zeros(0, np.int16)) == [] and own.parts(np.array([5, 5], np.int16)) == [(0, 2)]


def test_first_stage_keeps_what_the_tagger_finds():
    full = Tagger(TAGGER.w)
    filler = "The lessee shall keep the quay in good repair and pay no demurrage on Sundays. " * 60
    texts = [TEXT, filler, filler + TEXT + filler, "", "ab"]
    assert spans_in(texts, TAGGER) == spans_in(texts, full)
    parts = TAGGER.gate.parts(np.array([ord(c) - 31 for c in filler], np.int16))
    assert sum(e - s for s, e in parts) < len(filler) / 4
