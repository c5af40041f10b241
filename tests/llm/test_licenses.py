import random
import re
from collections import Counter

from plumbline.llm import licenses as L
from plumbline.llm.license_templates import TEXTS, phrases, templates


def words(text):
    return re.findall(r"[^\W_]+", text.lower())


def bag(w):
    return Counter(zip(w, w[1:]))


def brute(text, named, t):
    """Best Dice coefficient of any run of clauses, per licence."""
    cuts = [0, *(m.end() for m in re.finditer(r"\n|[.!?;](?=\s|\Z)", text)), len(text)]
    best = {}
    for i, a in enumerate(cuts):
        for b in cuts[i + 1 :]:
            own = bag(words(text[a:b]))
            for licence, template in named:
                other = bag(words(template))
                size = sum(own.values()) + sum(other.values())
                if size and (dice := 2 * sum((own & other).values()) / size) >= t - 1e-9:
                    best[licence] = max(best.get(licence, 0), dice)
    return best


def test_equals_brute_force():
    rng = random.Random(3)
    named = [("A", "alpha beta gamma delta epsilon. Zeta eta theta"), ("B", "one two three four"), ("B", "one two five six seven eight")]
    scanner = L.Scanner(named, 0.7)
    vocabulary = "alpha beta gamma delta epsilon zeta eta theta one two three four five six seven eight noise".split()
    texts = []
    for _ in range(300):
        parts = [" ".join(rng.sample(vocabulary, 3)) if rng.random() < 0.4 else rng.choice([t for _, t in named]) for _ in range(3)]
        texts.append(rng.choice([". ", "\n", "; ", " "]).join(parts))
    found = {}
    for n, licence, dice, _, _ in scanner.scan(texts):
        found[n, licence] = dice
    for n, text in enumerate(texts):
        want = brute(text, named, 0.7)
        mine = {licence: found[n, licence] for licence in "AB" if (n, licence) in found}
        assert set(mine) <= set(want) and all(abs(mine[x] - want[x]) < 1e-9 for x in mine), text
        assert not want or max(want.values()) - max(mine.values(), default=0) < 1e-9, text


def test_every_template_finds_itself():
    scanner = L.Scanner(templates(), 0.85)
    for n, (licence, text) in enumerate(templates()):
        hits = scanner.scan([f"Some words before it\n{text}\nsome words after it"])
        assert any(h[1] == licence and abs(h[2] - 1) < 1e-9 for h in hits) or any(h[2] > 0.999 for h in hits), text


def test_edited_licence_inside_a_file():
    text = "x = 1\n\n" + TEXTS["MIT"].strip().replace("sublicense", "resell").replace("\n", "\n# ") + "\n\ny = 2"
    (hit,) = L.Scanner(templates(), 0.85).scan([text])
    assert hit[1] == "MIT" and 0.9 < hit[2] < 1 and text[hit[3] : hit[4]].startswith("Permission") and text[hit[3] : hit[4]].endswith("SOFTWARE")


def test_hard_cases(hard, nothing, table):
    assert L.find_licences(hard).count() == 0
    assert L.find_licences(nothing).count() == 0
    rows = [(1, "Released under the MIT License."), (1, "Released under the MIT License."), (None, "Words.\nLicensed under CC BY-NC 4.0. Words"), (2, "Released under the MIT License. " * 2000)]
    got = sorted(((r.doc_id, r.licence, r.start, r.end) for r in L.find_licences(table(rows)).collect()), key=repr)
    assert got == sorted([(1, "MIT", 0, 30), (1, "MIT", 0, 30), (None, "CC-BY-NC-4.0", 7, 34), (2, "MIT", 0, 30)], key=repr)


def test_own_templates_and_templates_without_words(table):
    rows = L.find_licences(table([(1, "do what you like with it")]), named_texts=[("own", "Do what you like with it!"), ("none", ""), ("one", "word")]).collect()
    assert [(r.licence, r.dice) for r in rows] == [("own", 1.0)]


def best_of_words(text, named, t):
    """Best Dice coefficient of any run of words, per licence."""
    own, best = words(text), {}
    for licence, template in named:
        other = bag(words(template))
        for i in range(len(own)):
            for j in range(i + 2, len(own) + 1):
                mine = bag(own[i:j])
                dice = 2 * sum((mine & other).values()) / (sum(mine.values()) + sum(other.values()))
                if dice >= t - 1e-9:
                    best[licence] = max(best.get(licence, 0), dice)
    return best


def test_runs_of_words_equal_brute_force():
    rng = random.Random(5)
    named = [("A", "alpha beta gamma delta alpha beta epsilon"), ("B", "one two three four"), ("B", "one two five six seven eight")]
    scanner = L.Scanner(named, 0.7, True)
    vocabulary = "alpha beta gamma delta epsilon one two three four five six seven eight noise".split()
    for _ in range(300):
        parts = [" ".join(rng.sample(vocabulary, 3)) if rng.random() < 0.5 else rng.choice([t for _, t in named]) for _ in range(4)]
        text = rng.choice([". ", "\n", " "]).join(parts)
        want, found = best_of_words(text, named, 0.7), scanner.scan([text])
        assert max((x[2] for x in found), default=0) == max(want.values(), default=0), text
        assert all(own[2] <= want[own[1]] + 1e-9 for own in found)
        # Runs do not overlap, and no licence is left where no run stands.
        assert all(x[4] <= y[3] for x, y in zip(found, found[1:])), text
        rest, at = [], 0
        for x in found:
            rest.append(text[at : x[3]])
            at = x[4]
        assert not any(best_of_words(part, named, 0.7) for part in [*rest, text[at:]]), text


def test_statement_inside_a_clause(table):
    texts = ["This file is licensed under the MIT License.", "Copyright 2020 Jane Doe, released under the MIT License", "all code here is distributed under the Apache License, Version 2.0 and more of that"]
    got = {r.doc_id: (r.licence, r.dice, texts[r.doc_id][r.start : r.end]) for r in L.find_licences(table(list(enumerate(texts)))).collect()}
    assert got == {0: ("MIT", 1.0, "licensed under the MIT License"), 1: ("MIT", 1.0, "released under the MIT License"), 2: ("Apache-2.0", 1.0, "distributed under the Apache License, Version 2.0")}


def test_every_run_is_given(table):
    text = "Released under the MIT License, some words, licensed under the ISC License; again released under the MIT License"
    rows = L.find_licences(table([(1, text)]), every=True).collect()
    assert [(r.licence, text[r.start : r.end]) for r in rows] == [("MIT", "Released under the MIT License"), ("ISC", "licensed under the ISC License"), ("MIT", "released under the MIT License")]


def test_licence_whose_best_run_is_taken_stands_elsewhere(table):
    named = [("A", "a b c d e f g h"), ("B", "b c d e f g x")]
    text = "a b c d e f g h. Other words: b c d e f g y"
    got = L.find_licences(table([(1, text)]), threshold=0.7, named_texts=named).collect()
    assert {(r.licence, r.start > 0) for r in got} == {("A", False), ("B", True)}


def test_a_cut_name_is_not_another_licence(table):
    texts = ["Licensed under the BSD 4-Clause License", "This project is licensed under the Apache License, Version 1.1", "This work is licensed under the GNU General Public License"]
    assert L.find_licences(table(list(enumerate(texts)))).collect() == []


FOUNDATION = "as published by the Free Software Foundation"
GNU = """This {2} is free software{3} you can redistribute it and/or modify
it under the terms of the GNU {0}General Public License {1}

This {2} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU {0}General Public License for more details.

You should have received a copy of the GNU {0}General Public License along with this {2}"""


def test_notices_and_sentences_have_their_own_names(table):
    later = FOUNDATION + "; either version {} of the License, or (at your option) any later version."
    address = "; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA."
    link = ".  If not, see <http://www.gnu.org/licenses/>."
    texts = [
        ("GPL-2.0-or-later", GNU.format("", later.format(2), "program", ";") + address), ("GPL-2.0-or-later", GNU.format("", later.format(2), "program", ":") + link),
        ("GPL-3.0-or-later", GNU.format("", later.format(3), "program", ":") + link), ("GPL-2.0", GNU.format("", "version 2 " + FOUNDATION + ".", "program", ";") + link),
        ("GPL-3.0", GNU.format("", FOUNDATION + ", version 3 of the License.", "program", ":") + link), ("LGPL-2.1-or-later", GNU.format("Lesser ", later.format(2.1), "library", ";") + address),
        ("LGPL-3.0-or-later", GNU.format("Lesser ", later.format(3), "program", ":") + link), ("AGPL-3.0-or-later", GNU.format("Affero ", later.format(3), "program", ":") + link),
        ("AGPL-3.0", GNU.format("Affero ", FOUNDATION + ", version 3 of the License.", "program", ":") + link),
        ("BSD-3-Clause", TEXTS["BSD-2-Clause"].replace("THIS SOFTWARE IS PROVIDED BY", "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\nTHIS SOFTWARE IS PROVIDED BY", 1)),
        ("BSD-2-Clause", TEXTS["BSD-2-Clause"]),
        *((f"CC-{code}-4.0", f"This work is licensed under a Creative Commons Attribution{words} 4.0 International License") for code, words in (("BY", ""), ("BY-SA", "-ShareAlike"), ("BY-NC", "-NonCommercial"), ("BY-ND", "-NoDerivatives"), ("BY-NC-SA", "-NonCommercial-ShareAlike"), ("BY-NC-ND", "-NonCommercial-NoDerivatives"))),
    ]
    got = L.find_licences(table([(n, f"# Copyright 2020 Jane Doe\n\n{text}\n\nimport os\n") for n, (_, text) in enumerate(texts)]), every=True).collect()
    assert sorted((r.doc_id, r.licence) for r in got) == [(n, licence) for n, (licence, _) in enumerate(texts)]
    assert all(r.dice > 0.95 for r in got)


def test_every_licence_with_a_name_has_templates_of_its_own():
    scanner = L.Scanner(templates(), 0.85, True, phrases())
    for licence, text in templates():
        assert {h[1] for h in scanner.scan([f"words before it\n{text}\nwords after"])} == {licence}, text
