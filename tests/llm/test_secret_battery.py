"""The battery against a version in plain Python, and its measured recall and false share by length."""

import math
import random
import re
from collections import Counter, defaultdict

import pytest

from termlake.llm import secret_scan as scan
from termlake.llm.secret_scan import ENCODINGS, STRATA, secret_scan

from .helpers import docs

LENGTHS = (16, 20, 24, 32, 40, 64)
EACH = 60
# Made-up identifiers: joined words of prose with a number, as file names, slugs, variables and versions have them.
WORDS = (
    "river stone market engine paper garden window letter number report season travel winter summer planet system "
    "driver bridge castle forest island harbor museum theory matter record signal ticket valley volume filter index"
).split()


def random_token(rng, letters, n):
    while True:
        token = "".join(rng.choice(letters) for _ in range(n))
        if any(c.isdigit() for c in token) and any(c.isalpha() for c in token):
            return token


def identifier(rng, n):
    form = rng.randrange(6)
    token = ""
    while len(token) < n - 4:
        word = rng.choice(WORDS)
        token += [word.capitalize(), word + "-", word + "_", word + "/", word + str(rng.randrange(1, 30)), word.capitalize() + "-"][form]
    return token.rstrip("-_/") + str(rng.randrange(1, 2030))


def tail(z):
    return math.erfc(z / math.sqrt(2)) / 2


def plain_chances(token):
    """(p_random, p_prose) from counts and sums written out."""
    _, _, letters, repeat, change = next(e for e in ENCODINGS if re.search(e[1], token))
    n, size = len(token), len(letters)
    chi = sum((c - n / size) ** 2 / (n / size) for c in Counter(token).values()) + (size - len(set(token))) * n / size
    df = size - 1
    v = [letters.index(c) + 1 - (size + 1) / 2 for c in token]
    high = [x > 0 for x in v]
    up, runs = sum(high), 1 + sum(a != b for a, b in zip(high, high[1:]))
    mean = 1 + 2 * up * (n - up) / n
    z_runs = (runs - mean) / math.sqrt(max((mean - 1) * (mean - 2) / (n - 1), 0.01))
    centre = sum(v) / n
    d = [x - centre for x in v]
    z_lag = (sum(a * b for a, b in zip(d, d[1:])) / max(sum(x * x for x in d), 1e-9) + 1 / n) * math.sqrt(n)
    each = [tail((chi - df) / math.sqrt(2 * df * (n - 1) / n)), 2 * tail(abs(z_runs)), 2 * tail(abs(z_lag))]
    half = -sum(math.log(max(p, 1e-15)) for p in each)
    shift = n * (size * repeat - 1)
    kinds = [1 if c.isdigit() else 2 if c.isupper() else 3 if c.islower() else 4 for c in token]
    changes = sum(a != b for a, b in zip(kinds, kinds[1:]))
    z_flat = (df + shift - chi) / math.sqrt(2 * df + 4 * shift)
    z_changes = (changes - 0.5 - (n - 1) * change) / math.sqrt((n - 1) * change * (1 - change))
    return math.exp(-half) * (1 + half + half * half / 2), tail((z_flat + z_changes) / math.sqrt(2))


def planted(seed=5):
    """Tokens with the truth: (token, kind, length)."""
    rng = random.Random(seed)
    out = []
    for n in LENGTHS:
        for name, _, letters, *_ in ENCODINGS:
            if name == "hex" and n >= 24:
                continue  # a base span
            out += [(random_token(rng, letters, n), name, n) for _ in range(EACH)]
        out += [(identifier(rng, n), "identifier", n) for _ in range(EACH * 6)]
    rng.shuffle(out)
    return out


def test_battery_equals_plain_version(spark):
    tokens = planted()
    rows = scan.tested(docs(spark, [(i, f"see {t} here") for i, (t, _, _) in enumerate(tokens)])).collect()
    seen = 0
    for row in rows:
        for t in row.tokens:
            want = plain_chances(tokens[row.doc_id][0])
            assert t.p_random == pytest.approx(want[0], rel=1e-3, abs=1e-6)
            assert t.p_prose == pytest.approx(want[1], rel=1e-3, abs=1e-6)
            seen += 1
    assert seen > 0.9 * len(tokens)


def test_recall_and_false_share(spark):
    """On another seed than the rates were chosen on. The README states the figures by encoding and length."""
    tokens = planted(6)
    rows = secret_scan(docs(spark, [(i, f"see {t} here") for i, (t, _, _) in enumerate(tokens)])).collect()
    hit = {r.doc_id: any(s.kind == "random" for s in r.found) for r in rows}
    found, of = defaultdict(int), defaultdict(int)
    for i, (_, kind, n) in enumerate(tokens):
        of[kind, n] += 1
        found[kind, n] += hit[i]
    for key in sorted(of):
        print(*key, round(found[key] / of[key], 3))
    edges = [16, *STRATA, 10**6]
    for low, high, least in zip(edges, edges[1:], (0.7, 0.8, 0.9, 0.95)):
        mine = [k for k in of if low <= k[1] < high]
        true = sum(found[k] for k in mine if k[0] != "identifier")
        false = sum(found[k] for k in mine if k[0] == "identifier")
        recall, share = true / sum(of[k] for k in mine if k[0] != "identifier"), false / max(1, true + false)
        print(f"from {low}: recall {recall:.3f}, false share {share:.4f}")
        assert recall >= least and share <= 0.06
