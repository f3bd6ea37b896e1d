"""The license scan against every window of words and every notice."""

import random

import pytest

from tarnlake.llm import licenses

KNOWN = licenses.Notices(licenses.NOTICES)


def differences(notice, window, fixed, most):
    """The fewest words missing from and added to a notice in a window whose first and last word are its own; None above most."""
    barred = lambda w: w in fixed or any(map(str.isdigit, w))
    far = most + 1
    row = [0]
    for w in notice:
        row.append(far if w in fixed else min(far, row[-1] + 1))
    for j, w in enumerate(window):
        now = [far if j else 0]  # nothing is added before the first word
        inner = 0 < j < len(window) - 1
        for i, x in enumerate(notice):
            ways = [row[i] if w == x and (j == 0 or row[i] <= most) else far]
            if inner and not barred(w):
                ways.append(row[i + 1] + 1)
            now.append(min(far, *ways))
        # words of the notice that are missing after this word
        for i, x in enumerate(notice):
            if x not in fixed and now[i] + 1 < now[i + 1]:
                now[i + 1] = now[i] + 1
        if j == 0:
            now[0] = far
        row = now
    return row[-1] if row[-1] <= most else None


def brute(known, k, words):
    notice, most = known.notices[k][1], known.most[k]
    fixed = known.telling if len(notice) > 2 else set(notice)
    return any(differences(notice, words[i:j], fixed, most) is not None for i in range(len(words)) for j in range(i + 1, min(len(words), i + len(notice) + most) + 1) if words[i] in notice and words[j - 1] in notice)


@pytest.mark.parametrize("seed", range(8))
def test_every_window_and_notice(seed):
    rng = random.Random(seed)
    some = [w for _, n in KNOWN.notices for w in n]
    other = ["und", "mit", "der", "house", "river", "copy", "x1"]
    single = {k: licenses.Notices((licenses.NOTICES[k],)) for k in range(len(licenses.NOTICES))}
    hits = 0
    for _ in range(120):
        words = rng.choices(other, k=rng.randrange(12))
        for _ in range(rng.randrange(1, 4)):
            mine = list(KNOWN.notices[rng.randrange(len(licenses.NOTICES))][1])
            for _ in range(rng.randrange(4)):
                at = rng.randrange(len(mine))
                if rng.random() < 0.5 and len(mine) > 1:
                    del mine[at]
                else:
                    mine.insert(at, rng.choice([*other, *some]))
            words += mine + rng.choices([*other, *some], k=rng.randrange(6))
        text = " ".join(words)
        found = {name for name, *_ in KNOWN.scan(text)[1]}
        want = [k for k in range(len(licenses.NOTICES)) if brute(KNOWN, k, words)]
        assert found <= {licenses.NOTICES[k][0] for k in want}, text
        assert bool(found) == bool(want), (text, want)
        for k in rng.sample(range(len(licenses.NOTICES)), 4):
            assert bool(single[k].scan(text)[1]) == brute(single[k], 0, words), (text, licenses.NOTICES[k])
        hits += len(want)
    assert hits > 100


def test_ties_repeats_and_long_blocks():
    twice = licenses.Notices((("A", "Use it as you like, always."), ("B", "Use it as you like, always.")))
    assert [x[0] for x in twice.scan("Use it as you like, always.")[1]] == ["A"]
    for notice in ("Licensed under the Apache License, Version 2.0.", "SPDX-License-Identifier: GPL-3.0-only"):
        text = " ".join([notice] * 5000)
        assert len(KNOWN.scan(text)[1]) == 5000 and KNOWN.scan(text) == KNOWN.scan(text)
    assert KNOWN.scan("mit " * 50000)[1] == []
