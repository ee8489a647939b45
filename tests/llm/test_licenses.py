from __future__ import annotations

import random

import pytest

from quantspark.llm import licenses

from .helpers import awkward, documents

FILLER = "Erbleen ereati is ndinly thbleing eringing thines by threreatsh."


@pytest.mark.parametrize(("name", "wording"), licenses.TEMPLATES)
def test_every_wording_is_found_in_place(name, wording):
    text = f"{FILLER}\n{wording}\n{FILLER}"
    found = licenses.find_licenses(text)
    assert [f[0] for f in found] == [name]
    assert text[found[0][1] : found[0][2]] == wording


def test_small_changes_and_look_alikes():
    assert licenses.find_licenses("This work is LICENSED under the GNU general public license, version 3!")[0][0] == "GPL-3.0"
    apache = dict(reversed(licenses.TEMPLATES))["Apache-2.0"]
    assert licenses.find_licenses(apache.replace("License", "Licence", 1))[0][0] == "Apache-2.0"
    assert licenses.find_licenses("The driving license was issued, and the copyright of warranty is a word.") == []
    assert licenses.find_licenses("Licensed under CC BY-SA 4.0.")[0][0] == "CC-BY-SA-4.0"
    assert licenses.find_licenses("Licensed under CC BY 4.0.")[0][0] == "CC-BY-4.0"


@pytest.mark.parametrize(
    ("text", "name"),
    [
        ("Licensed under the BSD License.", "BSD"),
        ("Licensed under the ISC License.", "ISC"),
        ("Licensed under the Acme License.", None),
        ("Released under the MIT agreement.", "MIT agreement"),
        ("This work is licensed under the GNU General Public License, version 2.", "GPL-2.0"),
        ("This work is licensed under the GNU Lesser General Public License, version 3.", "LGPL-3.0"),
        ("This work is licensed under the GNU Fancy General Public License, version 7.", None),
        ("Licensed under the Apache License, Version 1.1.", "Apache-1.1"),
        ("Licensed under the Apache License, Version 3.0.", None),
        ("Licensed under CC BY 3.0.", None),
        ("Licensed under CC BY-ND 4.0.", "CC-BY-ND-4.0"),
        ("Licensed under CC BY-NC-ND 4.0.", "CC-BY-NC-ND-4.0"),
        ("This work is licensed under a Creative Commons Attribution-ShareAlike 3.0 International License.", None),
    ],
)
def test_no_license_is_named_that_is_not_there(text, name):
    want = [] if name in (None, "MIT agreement") else [name]
    assert [f[0] for f in licenses.find_licenses(f"{FILLER}\n{text}\n{FILLER}")] == want


def test_a_wording_with_the_name_of_another_is_not_the_first():
    """Every wording with its telling words replaced by those of any look-alike, and by words of none."""
    _, _, templates = licenses._templates()
    tried = 0
    for t in templates:
        for run in t.telling:
            words = t.words[: run[0]] + ["zorblax"] * len(run) + t.words[run[-1] + 1 :]
            if any(o.name == t.name and " ".join(o.words) in " ".join(words) for o in templates):
                continue  # a shorter notice of the same license is still whole
            tried += 1
            assert t.name not in [f[0] for f in licenses.find_licenses(" ".join(words))], (t.name, words)
    assert tried > 40
    for name, wording in licenses.TEMPLATES:
        for other in {n for n, _ in licenses.TEMPLATES} - {name}:
            assert other not in [f[0] for f in licenses.find_licenses(wording)]


def test_the_cue_lets_through_all_that_is_confirmed(monkeypatch):
    rng = random.Random(3)
    texts = []
    for _ in range(150):
        words = rng.choice(licenses.TEMPLATES)[1].split()
        for _ in range(rng.randint(1, max(1, len(words) // 6))):
            words[rng.randrange(len(words))] = "zorblax"
        texts.append(" ".join(words))
    with_cue = [licenses.find_licenses(t) for t in texts]
    monkeypatch.setattr(licenses, "CUE", __import__("re").compile(""))
    assert with_cue == [licenses.find_licenses(t) for t in texts] and sum(map(bool, with_cue)) > 30


def test_long_notice_over_lines():
    wording = next(w for n, w in licenses.TEMPLATES if n == "MIT" and len(w) > 200)
    words = wording.split()
    lines = "\n".join(" ".join(words[i : i + 9]) for i in range(0, len(words), 9))
    assert any(f[0] == "MIT" for f in licenses.find_licenses(lines))


def test_queries_and_awkward_rows(spark):
    docs = documents(spark, [None, "", FILLER, f"{FILLER}\nReleased under the MIT License.", "Licensed under CC BY-NC 4.0.\n" + FILLER * 4000])
    rows = {(r.doc_id, r.license, r.start) for r in licenses.license_digest(docs).collect()}
    assert rows == {(3, "MIT", len(FILLER) + 1), (4, "CC-BY-NC-4.0", 0)}
    odd = awkward(spark)
    assert licenses.with_licenses(odd).columns == [*odd.columns, "licenses"]
    assert licenses.license_digest(odd).count() == 0 and licenses.license_digest(odd.limit(0)).count() == 0


def _wrap(wording, width, sign=""):
    words = wording.split()
    return "\n".join(sign + " ".join(words[i : i + width]) for i in range(0, len(words), width))


@pytest.mark.parametrize(("name", "wording"), licenses.TEMPLATES)
@pytest.mark.parametrize(("width", "sign"), [(9, ""), (7, "# "), (1, " * ")])
def test_wrapped_wordings_are_found_whole(name, wording, width, sign):
    text = f"{FILLER}\n{_wrap(wording, width, sign)}\n{FILLER}"
    found = licenses.find_licenses(text)
    assert [f[0] for f in found] == [name]
    assert [w for w in text[found[0][1] : found[0][2]].split() if w != sign.strip()] == wording.split()


def test_two_licenses_side_by_side_and_in_one_sentence():
    mit, apache = "Licensed under the MIT License.", "Licensed under the Apache License, Version 2.0."
    text = f"{mit}\n{apache}"
    assert [(f[0], text[f[1] : f[2]]) for f in licenses.find_licenses(text)] == [("MIT", mit), ("Apache-2.0", apache)]
    for text in ("Licensed under the MIT License or the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 or the MIT License."):
        assert {f[0] for f in licenses.find_licenses(text)} == {"MIT", "Apache-2.0"}
    every = dict(licenses.TEMPLATES)
    text = "\n".join(every.values())
    assert [f[0] for f in licenses.find_licenses(text)] == list(every)
    assert [f[0] for f in licenses.find_licenses(f"{mit}\n{FILLER}\n{mit}")] == ["MIT", "MIT"]


@pytest.mark.parametrize("before", [8100, 8192, 20000])
def test_notice_inside_a_long_line(before):
    wording = next(w for n, w in licenses.TEMPLATES if n == "MIT" and len(w) > 200)
    text = (FILLER * 400)[: before - 1] + " " + wording + " " + FILLER * 300
    assert [(f[0], text[f[1] : f[2]]) for f in licenses.find_licenses(text)] == [("MIT", wording)]


def test_scattered_words_are_no_notice():
    words = "licensed under the mit license".split()
    assert licenses.find_licenses(" ".join(w + " erbleen ndinly thbleing eringing thines by ereati" for w in words)) == []


def confirmed_by_force(text, at_most=14):
    """(name, first word, word behind the last) of every run of words that a short template confirms."""
    places = [m.span() for m in licenses.WORDS.finditer(text)]
    words = [text[a:b].lower() for a, b in places]
    out = set()
    for i, (name, wording) in enumerate(licenses.TEMPLATES):
        template = licenses.WORDS.findall(wording.lower())
        if len(template) > at_most:
            continue
        for first in range(len(words)):
            for last in range(first + 1, min(len(words), first + 2 * len(template)) + 1):
                if sum(w in template for w in words[first:last]) < licenses.MIN_EQUAL * len(template):
                    continue
                block = " ".join(text[places[first][0] : licenses.TAIL.match(text, places[last - 1][1]).end()].lower().split())
                if licenses.size_reduction(i, block)[1] >= licenses.MIN_REDUCTION and len(licenses.same_words(i, block)[1]) >= licenses.MIN_EQUAL * len(template) and licenses.names_it(i, block):
                    out.add((name, places[first][0], places[last - 1][1]))
    return out


def test_nothing_is_missed_or_made_up():
    """Every run that some template confirms lies in a reported one, and every reported one is such a run."""
    rng = random.Random(8)
    short = [(n, w) for n, w in licenses.TEMPLATES if len(licenses.WORDS.findall(w)) <= 14]
    hits = 0
    for _ in range(60):
        parts = []
        for _ in range(rng.randint(1, 3)):
            words = rng.choice(short)[1].split()
            for _ in range(rng.randint(0, 2)):
                k = rng.randrange(len(words))
                words[k : k + 1] = rng.choice([[], ["other"], [words[k], "indeed"]])
            parts += [" ".join(FILLER.split()[: rng.randint(1, 9)]), " ".join(words)]
        text = rng.choice(["\n", " "]).join(parts)
        found, force = licenses.find_licenses(text), confirmed_by_force(text)
        hits += len(found)
        for name, a, b in force:
            assert any(f[1] < b and a < f[2] for f in found), (text, name)
        for name, a, b, *_ in found:
            assert any(n == name and a <= x and y <= b for n, x, y in force), (text, name)
    assert hits > 60
