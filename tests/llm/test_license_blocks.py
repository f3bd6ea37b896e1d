"""License notices wherever they stand in a text."""

import random

from tarnlake.llm import licenses

KNOWN = licenses.Notices(licenses.NOTICES)
WORDS = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(500)]


def found(text, known=KNOWN):
    return [(name, line) for name, line, _, _ in known.scan(text)[1]]


def test_notice_in_a_line_of_any_length():
    for n in (0, 20, 100, 500, 20000):
        rest = " ".join(random.Random(n).choices(WORDS, k=n))
        for name, notice in licenses.NOTICES:
            for text in (f"{rest} {notice}", f"{notice} {rest}", f"{rest} {notice} {rest}"):
                assert KNOWN.scan(text) == (1, [(name, 0, *KNOWN.scan(notice)[1][0][2:])]), (n, notice)


def test_allowed_differences_are_never_too_small_a_reduction():
    rng = random.Random(3)
    for _ in range(2000):
        k = rng.randrange(len(licenses.NOTICES))
        name, notice = KNOWN.notices[k]
        words = list(notice)
        for _ in range(KNOWN.most[k]):
            loose = [i for i, w in enumerate(words) if w in notice and w not in KNOWN.telling]
            if loose and rng.random() < 0.5:
                del words[rng.choice(loose)]
            elif len(words) > 1:
                words.insert(rng.randrange(1, len(words)), rng.choice(["aaa", "documents", "xylophone"]))
        if any(cue in " ".join(words) for cue in licenses.CUES):
            assert (name, 0) in found(" ".join(words)), words


def test_all_notices_of_a_line():
    for a, one in licenses.NOTICES:
        for b, two in licenses.NOTICES:
            assert found(f"{one} {two}") == [(a, 0), (b, 0)], (one, two)
    assert found("Licensed under the MIT License or the Apache License, Version 2.0.") == [("MIT", 0), ("Apache-2.0", 0)]
    assert found("Licensed under the MIT License. " * 3000) == [("MIT", 0)] * 3000
    assert found(" ".join(x for _, x in licenses.NOTICES * 20)) == [(name, 0) for name, _ in licenses.NOTICES * 20]


def test_wrapped_notices():
    for name, notice in licenses.NOTICES:
        words = notice.split()
        for begin, mark in (("", ""), ("# ", "# "), ("/* ", " * "), ("", "\n"), ("\t", "\r\n\t")):
            for i in range(1, len(words)):
                text = "some words\n" + begin + " ".join(words[:i]) + "\n" + mark + " ".join(words[i:]) + "\nother words"
                assert found(text) == [(name, 1)], text
            assert found(begin + ("\n" + mark).join(words)) == [(name, 0)]
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal"
    assert found(mit) == [("MIT", 0)]


def test_templates_without_a_cue():
    body = "Redistribution and use in source and binary forms, with or without modification, are permitted."
    for given in ((("BSD", body),), (*licenses.NOTICES, ("BSD", body)), (("own", "Use it as you like."), ("BSD", body))):
        known = licenses.Notices(given)
        assert not any(cue in body.lower() for cue in licenses.CUES)
        assert found(body, known) == [("BSD", 0)]
        words = known.notices[-1][1]
        for i in range(len(words) - known.most[-1] + 1):  # as many words away as may be
            rest = [w for j, w in enumerate(words) if not i <= j < i + known.most[-1] or w in known.telling]
            assert found(f"first\n{' '.join(rest)}", known) == [("BSD", 1)], rest
    assert found("Use it as you like.", licenses.Notices((("own", "Use it as you like."),))) == [("own", 0)]
