"""Personal data: the patterns against plain regular expressions, the network on held-out notations."""

import re

import numpy as np

from strataforge.llm import pii


def plain(text):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()]
        if 16 <= len(d) <= 19 and sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(d[::-1])) % 10 == 0:
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(out)


def test_patterns(documents):
    rng = np.random.default_rng(0)
    texts = [r.text for r in documents.collect()]
    texts += ["a@b.c@d.e f@g h@i.j.k..l @x.y z%@q-.w", "1.2.3.4.5.6.7.8 256.1.1.1 0001.2.3.4", "4111 1111 1111 1111-4111111111111111 4111-1111-1111-1112", "+1 (555) 123-4567. +49 30 1 +123", "x@y.z+12345678901"]
    texts += ["".join(rng.choice(list("0149.@+ -()ab%_"), 60)) for _ in range(800)]
    for t in texts:
        assert sorted(pii.base_spans(t)) == plain(t), t


def test_network():
    c, y = pii.training_set(["the lord of red and green over there was an old man in the sea " * 20], 1024)
    tagger = pii.Tagger()
    losses = tagger.train(c, y, epochs=12)
    assert losses[-1] < losses[0] / 10
    rng = np.random.default_rng(99)
    hits, asked, wrong = 0, 0, 0
    for _ in range(300):
        value, kind = pii.rewritten(rng)
        found = pii.model_spans([f"Many words and {value} over there, my lord."], tagger)[0]
        if kind is None:
            wrong += bool(found)
        elif pii.plausible(kind, value) and not re.search(r"\bat\b", value):  # those are in test_notations
            asked += 1
            hits += (kind, 15, 15 + len(value)) in found
    assert asked > 30 and hits / asked > 0.7 and wrong < 12


def test_gradients():
    rng = np.random.default_rng(2)
    tagger = pii.Tagger(hidden=3, embed=2, dtype=float)
    c, y = rng.integers(0, 20, (3, 6)), rng.integers(0, pii.TAGS, (3, 6))
    _, grads = tagger.step(c, y)
    for name, at in (("E", (3, 1)), ("Wf", (2, 5)), ("wb", (4,)), ("O", (1, 2)), ("T", (0, 3))):
        at = tuple(min(i, n - 1) for i, n in zip(at, tagger.p[name].shape, strict=True))
        if name == "E":
            at = (int(c[0, 0]), 1)
        old, eps, both = tagger.p[name][at], 1e-5, []
        for d in (eps, -eps):
            tagger.p[name][at] = old + d
            both.append(tagger.step(c, y)[0])
        tagger.p[name][at] = old
        assert abs((both[0] - both[1]) / (2 * eps) - grads[name][at]) < 1e-5


def test_decode_is_the_best_path():
    import itertools

    tagger = pii.Tagger(hidden=3, embed=2)
    tagger.p["T"] = np.random.default_rng(1).normal(0, 1, (pii.TAGS, pii.TAGS))
    c = np.array([[1, 3, 7, 2]])
    e = tagger.emissions(c)[0]
    best = max(itertools.product(range(pii.TAGS), repeat=4), key=lambda p: sum(e[i, t] for i, t in enumerate(p)) + sum(tagger.p["T"][a, b] for a, b in itertools.pairwise(p)))
    assert tuple(tagger.decode(c)[0]) == best


def test_windows_and_reconciling():
    text = "a" * 70 + "5" + "b" * 100
    starts, c = pii.windows(text)
    assert all((row == 3).any() for row in c) and {32, 64} == set(starts.tolist())
    tags = np.zeros((2, 64), int)
    tags[0, 38], tags[1, 6] = 1, 3
    assert pii.reconcile(len(text), starts, tags)[70] == 1


def test_frame(odd, empty, documents):
    rows = pii.find_personal_data(odd, epochs=1).collect()
    assert len(rows) == odd.count()
    spans = {r.doc_id: [(s["kind"], s["start"], s["end"]) for s in r.spans] for r in rows}
    text = "password=hunter2xyz mail a.b@c.de call +1 (555) 123-4567 at 10.0.0.1 card 4111 1111 1111 1111"
    assert sorted(s for s in spans[8] if s[0] in pii.KINDS) == plain(text)
    assert spans[3] == spans[4] == spans[7] == []
    assert pii.find_personal_data(empty, epochs=1).count() == 0
    out = {r.doc_id: r for r in pii.masked(odd, epochs=1).collect()}
    assert out[8].text == "password=hunter2xyz mail <EMAIL> call <PHONE> at <IP> card <CARD>" and out[8].n_chars == len(out[8].text)
    assert out[4].text is None and out[3].text == ""


def test_regions_cover_what_is_plausible():
    rng = np.random.default_rng(4)
    parts = ["ab", "c", "1", "22", "333", "4444", ".", "@", "(at)", "[at]", " at ", " ", "  ", "(dot)", "[dot]", " dot ", "[.]", "(.)", "-", "+", "漢", "٣"]
    seen = set()
    texts = ["a 1.22[.]333(.)4 b", "٣.22.1.1  ab", "1.1.1.1.1.1"] + ["".join(rng.choice(parts, rng.integers(4, 16))) for _ in range(600)]
    for text in texts:
        covered = np.zeros(len(text), bool)
        for a, b in pii.regions(text):
            covered[a:b] = True
        for kind in pii.KINDS:
            for a in range(len(text)):
                for b in range(a + 3, len(text) + 1):
                    if pii.plausible(kind, text[a:b]):
                        seen.add(kind)
                        assert covered[max(0, a - 1) : b + 1].all(), (kind, text, a, b)
    assert {"email", "ip", "phone"} <= seen


def test_notations(documents):
    """Recall of every notation of an address on its own, in real text; and windows left out change nothing."""
    texts = [r.text[:4000] for r in documents.where("length(text) > 600").limit(120).collect()]
    tagger = pii.Tagger()
    tagger.train(*pii.training_set(texts, 3072))
    rng = np.random.default_rng(99)
    assert pii.model_spans(["call 1.2.3.² now"], tagger) == [[]]
    said = [("write to ", "john at host dot com", " please"), ("", "john.smith at example dot com", ""), ("or ask ", "jane_doe at mail dot org", " for it"), ("the ", "anna at uni dot de", " one")]
    assert sum(("email", len(a), len(a + b)) in pii.model_spans([a + b + c], tagger)[0] for a, b, c in said) >= 2
    for at, dot in pii.SIGNS:
        hits = 0
        for _ in range(40):
            value, text, cut = pii.address(rng, at, dot), texts[rng.integers(len(texts))], int(rng.integers(0, 200))
            head = text[:cut].rsplit(" ", 1)[0] + " "
            whole = f"{head}{value} {text[cut : cut + 150]}"
            found = pii.model_spans([whole], tagger)[0]
            starts = np.arange(0, max(1, len(whole) - pii.WINDOW + pii.STRIDE), pii.STRIDE)
            padded = np.concatenate([pii.codes(whole), np.zeros(pii.WINDOW, np.int64)])
            tags = pii.reconcile(len(whole), starts, tagger.decode(padded[starts[:, None] + np.arange(pii.WINDOW)]))
            every = [(k, a + len(whole[a:b]) - len(whole[a:b].lstrip()), a + len(whole[a:b].rstrip())) for k, a, b in pii.spans_of(tags)]
            assert found == [s for s in every if s[1] < s[2] and pii.plausible(s[0], whole[s[1] : s[2]])]
            hits += ("email", len(head), len(head) + len(value)) in found
        assert hits >= 20, (at, dot, hits)
