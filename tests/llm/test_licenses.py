"""License notices among other legal wording."""

import random

import pytest

from tally.llm import licenses

TERMS = """These general terms govern the use of this software and its associated documentation, and any copyright in them stays with the owner.
You may not redistribute copies of the work in source or binary form, with or without modification, unless the above conditions and this list are met.
The software is provided without warranty of any kind, either express or implied, and the license may be changed subject to applicable law."""
SHORT = ("Apache-2.0", "MIT", "GPL-3.0", "LGPL-3.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0", "CC-BY-4.0-text", "CC0-1.0")


def names(text):
    return [x[2] for x in licenses.Scanner(licenses.TEMPLATES, licenses.TOLERANCE).scan(text)]


@pytest.mark.parametrize("name", SHORT)
def test_a_short_notice_inside_legal_prose(name):
    notice = licenses.TEMPLATES[name]
    assert names(f"{TERMS}\n{notice}") == [name]
    assert names(f"{TERMS}\n{notice}\n{TERMS}") == [name]
    assert names(TERMS) == []


def test_several_short_notices_inside_legal_prose():
    few = [licenses.TEMPLATES[x] for x in ("MIT", "CC-BY-4.0", "CC0-1.0", "GPL-3.0")]
    assert names("\n".join(x for n in few for x in (TERMS, n, TERMS))) == ["MIT", "CC-BY-4.0", "CC0-1.0", "GPL-3.0"]


def test_a_short_notice_in_long_text_of_one_block():
    rng = random.Random(3)
    for n in (200, 1000):
        body = [" ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 9))) for _ in range(12)) + " license" for _ in range(n)]
        body.insert(n // 2, licenses.TEMPLATES["MIT"])
        assert names("\n".join(body)) == ["MIT"]


def test_stray_words_far_from_a_notice():
    found = {k: licenses.TEMPLATES[k] for k in ("MIT-text", "ISC")}
    reserved = "Copyright 2020 Foo. All rights reserved."
    intro = "Copyright notice: see the file that comes with this work for all terms."
    warranty = "The above software is provided as is, without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement. In no event shall the authors or copyright holders be liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection with the software or the use or other dealings in the software."
    mit = found["MIT-text"].replace("substantial portions of the Software", "copies of it")
    isc = found["ISC"].replace("Permission to use", "You may use")
    ask = "Permission is needed from the owner to do anything with this that the following terms leave out."
    for text, name in ((f"{intro}\n{reserved}", "all-rights-reserved"), (f"{TERMS}\n{reserved}\n{TERMS}", "all-rights-reserved"), (f"{mit}\n{warranty}", "MIT-text"), (f"{ask}\n{isc}", "ISC")):
        rows = licenses.Scanner(licenses.TEMPLATES, licenses.TOLERANCE).scan(text)
        assert [x[2] for x in rows] == [name]
    (start, end, _, _, missing, added, wording), = licenses.Scanner(licenses.TEMPLATES, licenses.TOLERANCE).scan(f"{intro}\n{reserved}")
    assert (start, end) == (len(intro) + 1, len(intro) + len(reserved)) and (missing, added) == (0, 2) and wording == " -> 2020 foo"
    rows = licenses.Scanner(licenses.TEMPLATES, licenses.TOLERANCE).scan(f"{warranty}\n{mit}\n{warranty}")
    assert [(x[0], x[2]) for x in rows] == [(len(warranty) + 1, "MIT-text")]


PROSE = "It was a calm day and nobody in the village knew what the river would bring before the evening came."


def wrapped(text, width, sign=""):
    import textwrap
    return "\n".join(sign + x for x in textwrap.wrap(text, width - len(sign), break_long_words=False))


@pytest.mark.parametrize("name", sorted(licenses.TEMPLATES))
def test_every_template_in_every_layout(name):
    notice = licenses._HOLE.sub("Foo", licenses.TEMPLATES[name])
    for width, sign in ((20, ""), (30, ""), (40, "// "), (50, "# "), (60, ""), (60, " * "), (72, ""), (80, ";; ")):
        for before, after in ((PROSE, PROSE), ("", ""), (PROSE * 30, ""), ("", PROSE * 30)):
            text = f"{before}\n{wrapped(notice, width, sign)}\n{after}"
            assert name in names(text), (width, sign)
            assert len(names(text)) == 1
    for times in (1, 10, 200):  # on one long line
        assert names(f"{PROSE * times} {notice} {PROSE * times}") == [name]
    want = licenses.Scanner(licenses.TEMPLATES, licenses.TOLERANCE).words[name]
    rng = random.Random(name)
    for _ in range(10):  # as many words missing as may be, the cues among them first
        gone = sorted(range(len(want)), key=lambda i: (licenses.LEGAL.search(want[i]) is None, rng.random()))[: int(0.1 * len(want))]
        text = f"{PROSE}\n{wrapped(' '.join(w for i, w in enumerate(want) if i not in gone), 50)}\n{PROSE}"
        assert names(text) == [name]


def test_a_long_template_and_one_without_legal_words():
    rng = random.Random(9)
    long = " ".join("".join(rng.choices("abcdefgh", k=rng.randint(2, 9))) for _ in range(1700))
    given = {"long": long, "plain": "Take it and do whatever you like with these pages, friend."}
    scanner = licenses.Scanner(given, 0.1)
    for text, want in ((long, ["long"]), (f"{PROSE} {long} {PROSE}", ["long"]), (wrapped(given["plain"], 20, "# "), ["plain"]), (f"{PROSE}\n{wrapped(long, 40)}\n{given['plain']}", ["long", "plain"])):
        assert [x[2] for x in scanner.scan(text)] == want


def test_notices_at_all_places_of_long_blocks():
    """Windows end at no notice's cost: many in a row, apart by any number of words."""
    rng = random.Random(10)
    order = [rng.choice([k for k in licenses.TEMPLATES if k != "Apache-2.0"]) for _ in range(60)]
    filler = PROSE.split()
    text = "\n".join(f"{' '.join(rng.choices(filler, k=rng.randint(0, 40)))}\n{licenses._HOLE.sub('Foo', licenses.TEMPLATES[k])}" for k in order)
    assert names(text) == order


def test_work_grows_with_the_number_of_notices():
    import time
    scanner = licenses.Scanner(licenses.TEMPLATES, licenses.TOLERANCE)
    took = {}
    for n in (100, 400):
        text = "\n".join(f"{PROSE} {licenses.TEMPLATES['MIT']}" for _ in range(n))
        began = time.perf_counter()
        assert len(scanner.scan(text)) == n
        took[n] = time.perf_counter() - began
    assert took[400] < 8 * took[100]
    began = time.perf_counter()
    assert scanner.scan((PROSE + "\n") * 50_000 + "license") == [] and time.perf_counter() - began < 5
