import hashlib

import pytest

from kalendry.llm import fingerprint as fp


def lcs(a, b):
    last = [0] * (len(b) + 1)
    for x in a:
        row = [0]
        for j, y in enumerate(b):
            row.append(last[j] + 1 if x == y else max(last[j + 1], row[-1]))
        last = row
    return last[-1]


def plain_likeness(a, b):
    if a == b:
        return 1.0
    (p, *x), (q, *y) = a.split(":"), b.split(":")
    p, q, best = int(p), int(q), 0.0
    for s, t, size, other in [(x[0], y[0], p, q), (x[1], y[1], 2 * p, 2 * q), (x[0], y[1], p, 2 * q), (x[1], y[0], 2 * p, q)]:
        run = min(fp.RUN, len(s), len(t))
        if size == other and run and any(s[i : i + run] in t for i in range(len(s) - run + 1)):
            best = max(best, 2 * lcs(s, t) / (len(s) + len(t)))
    return best


def brute(rows):
    """Pairs of (doc_id, text) in order, by plain Python."""
    out = []
    for i, (doc_id, text) in enumerate(rows):
        text, after = text or "", rows[(i + 1) % len(rows)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        f, g, h = map(fp.fingerprint, (text, edited, after))
        out.append((doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), f, g, plain_likeness(f, g), plain_likeness(f, h)))
    return out


def as_rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("part", [20_000, 30, 1])
def test_equals_brute_force(small_docs, part):
    rows = sorted((r.doc_id, r.text) for r in small_docs.collect())
    got = as_rows(fp.fingerprints(small_docs, rows_per_part=part))
    want = sorted(brute(rows), key=str)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert all(g[5:] == pytest.approx(w[5:]) for g, w in zip(got, want, strict=True))


def test_properties():
    text = " ".join(hashlib.md5(str(i).encode()).hexdigest()[:6] for i in range(3000))
    f = fp.fingerprint(text)
    assert f == fp.fingerprint(str(text)) and 24 <= len(f.split(":")[1]) <= 64
    moved = "some new words up front " + text
    assert fp.likeness([(f, fp.fingerprint(moved)), (f, f), (f, fp.fingerprint(text[::-1]))])[0] > 0.9
    assert fp.likeness([(f, fp.fingerprint(text[::-1]))])[0] == 0
    assert fp.fingerprint("") == "1::" and fp.likeness([("1::", "1::"), ("1::", f)]).tolist() == [1, 0]


def test_defined_cases(make_docs):
    docs = make_docs(["", None, "héllo \U0001f600 wörld", "a" * 50000, (3, "b"), (3, "b"), (None, "n"), "zz"], extra=True)
    rows = [(None, "n"), (0, ""), (1, None), (2, "héllo \U0001f600 wörld")]
    got = as_rows(fp.fingerprints(docs, rows_per_part=2))
    assert len(got) == 8
    first = [g for g in got if g[0] in (None, 0, 1)]
    assert [g[:5] for g in first] == [w[:5] for w in sorted(brute(rows)[:3], key=str)]
    assert fp.fingerprints(docs.limit(0)).count() == 0
    assert as_rows(fp.fingerprints(make_docs(["alone here"])))[0][2] == hashlib.sha256(b"alonealone").hexdigest()
