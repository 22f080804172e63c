import numpy as np
import odd

from cleansheet.llm import licences

NEGATIVES = [odd.prose(i, 30) for i in range(200)]
MODEL = licences.fit(NEGATIVES)


def found(spark, rows):
    return {(r["doc_id"], r["family"], r["start"], r["end"]) for r in licences.find_notices(odd.frame(spark, rows), MODEL).collect()}


def test_templates_and_prose(spark):
    rows, want, n = [], set(), 0
    for family, templates in licences.TEMPLATES.items():
        for template in templates:
            lead = odd.prose(n, 20) + "\né "
            rows.append((n, lead + template + ".\n" + odd.prose(n + 1, 20)))
            want.add((n, family))
            n += 1
    rows += [(1000 + i, odd.prose(5000 + i, 100)) for i in range(60)]
    rows += [(2000, "the license version of the software is free"), (2001, "released under the bridge of general terms"),
             (2002, "public domain of the copy license work 4.0")]
    got = found(spark, rows)
    assert {(d, f) for d, f, _, _ in got} == want
    text = dict(rows)
    for d, family, start, end in got:
        assert any(text[d][start:end].rstrip(".").endswith(t.rstrip(".")) for t in licences.TEMPLATES[family])


def test_notice_deep_inside_a_long_line(spark):
    notice = "Licensed under the Apache License, Version 2.0"
    text = odd.prose(1, 500) + " " + notice + " " + odd.prose(2, 500)
    (hit,) = found(spark, [(1, text)])
    assert hit[:2] == (1, "Apache-2.0") and hit[2] <= text.index(notice) and hit[3] >= text.index(notice) + len(notice)


def test_several_notices_in_one_window(spark):
    mit, apache = "Released under the MIT License", "Licensed under the Apache License, Version 2.0"
    rows = [(1, "Licensed under the Apache License, Version 2.0 or the MIT license"), (2, f"{mit}. {apache}."),
            (3, f"{odd.prose(1, 8)} {apache} {odd.prose(2, 6)} {mit} {odd.prose(3, 8)}"),
            (4, "Licensed under the GNU Affero General Public License, version 3 or later")]
    got = {}
    for d, family, _, _ in found(spark, rows):
        got.setdefault(d, set()).add(family)
    both = {"MIT", "Apache-2.0"}
    assert got == {1: both, 2: both, 3: both, 4: {"AGPL"}}


def test_notice_wrapped_over_lines(spark):
    notice = "This work is licensed under a Creative Commons\nAttribution 4.0 International License"
    lead = odd.prose(1, 20)
    rows = [(1, f"{lead}\n{notice}\n{odd.prose(2, 20)}"), (2, notice), (3, notice.replace("\n", "\n \n"))]
    got = {(d, f, rows[d - 1][1][a:b]) for d, f, a, b in found(spark, rows)}
    assert {(d, f) for d, f, _ in got} == {(1, "CC-BY"), (2, "CC-BY")}
    assert all("Creative Commons\nAttribution 4.0" in t and len(t) <= len(notice) for _, _, t in got)


def test_unknown_is_calibrated():
    texts, labels = licences._examples([odd.prose(9000 + i, 25) for i in range(200)], np.random.RandomState(77), copies=12)
    chance = np.concatenate([MODEL.probabilities(licences.pieces([t.encode()]))[:1] for t in texts])
    best, sure = chance.argmax(1), chance.max(1)
    assert (best == labels).mean() > 0.93
    for low, high in ((0.5, 0.8), (0.8, 0.95), (0.95, 1.01)):
        inside = (sure >= low) & (sure < high)
        if inside.sum() > 40:
            assert (best == labels)[inside].mean() > low - 0.15


def test_odd_tables(spark):
    assert found(spark, odd.texts()) == set()
    assert found(spark, []) == set()
    notice = "Released under the MIT License"
    assert found(spark, [(None, notice), (1, notice), (1, notice), (2, "x\n" + notice)]) == {
        (None, "MIT", 0, 30), (1, "MIT", 0, 30), (2, "MIT", 2, 32)}
    assert isinstance(licences.train(odd.frame(spark, [])), licences.Model)


def test_slices_change_nothing(spark, monkeypatch):
    model = licences.fit(["some prose that is no notice at all"])
    p = licences.pieces([("a b c d " * 400 + "Licensed under the MIT license. " * 5 + "x\n" * 50).encode()])
    whole = model.probabilities(p)
    monkeypatch.setattr(licences, "SLICE_WORDS", 70)
    assert len(whole) > 20 and abs(model.probabilities(p) - whole).max() < 1e-5
