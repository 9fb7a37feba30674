"""Quoted parts in their parents, and names among known ones, against plain searches."""

import difflib
import random
import re

import pytest

from basalt.operators import matching


def plain_span(text, part):
    """A search with a pattern in which every white space stands for any."""
    bare = part.strip()
    if not bare:
        return None
    if bare in text:
        return text.index(bare), text.index(bare) + len(bare), "exact"
    words = bare.split()
    found = re.search(r"\s+".join(map(re.escape, words)), text)
    if found:
        return found.start(), found.end(), "space"
    return None


@pytest.mark.parametrize("seed", range(3))
def test_spans_with_other_white_space(spark, seed):
    r = random.Random(seed)
    words, spaces = ["a", "bb", "ccc", "é", "日本", "x.", "a b"], [" ", "  ", "\n", "\t ", " \n\n ", "　"]
    parents, parts = [], []
    for p in range(40):
        ws = [r.choice(words) for _ in range(r.randrange(1, 60))]
        text = r.choice(["", " ", "\n"]) + "".join(w + r.choice(spaces) for w in ws)
        parents.append((p, text))
        for k in range(12):
            a = r.randrange(len(ws))
            some = ws[a : a + r.randrange(1, 12)]
            part = r.choice(["", " "]) + "".join(w + r.choice(spaces) for w in some)
            parts.append((p, p * 100 + k, r.choice([part, part, part + "nowhere", "", None])))
    parts.append((999, 1, "a"))
    got = matching.spans(spark.createDataFrame(parents, "parent_id long, text string"), spark.createDataFrame(parts, "parent_id long, id long, part string").repartition(3))
    text_of = dict(parents)
    for x in got.collect():
        text, part = text_of.get(x["parent_id"]), x["part"]
        want = plain_span(text, part) if text is not None and part is not None else None
        if want is None and x["how"] == "anchor":
            assert len(" ".join(part.split())) > matching.ANCHOR
            continue
        assert (x["first"], x["last"], x["how"]) == (want or (None, None, None)), (text, part)
        assert x["found"] == (text[want[0] : want[1]] if want else None)


def test_anchors(spark):
    text = "before " + "word " * 30 + "end"
    part = ("word\n" * 30) + "but another end"
    x = matching.span(matching.Collapsed(text), part)
    assert x == (7, min(len(text), 7 + len(part)), "anchor")
    assert matching.span(matching.Collapsed(text), "another " + part) is None


def get_close(value, names):
    """The documented order over all names, with the library's own ratio."""
    key = matching.folded(value)
    for n in sorted(names):
        if matching.folded(n) == key:
            return n
    best = None
    for n in sorted(names):
        s = difflib.SequenceMatcher(None, matching.folded(n), key)
        if s.ratio() >= 0.72 and (best is None or (s.ratio(), matching.folded(n)) > best[:2]):
            best = (s.ratio(), matching.folded(n), n)
    return best and best[2]


@pytest.mark.parametrize("block", [7, 5000])
def test_closest_names(spark, block):
    r = random.Random(2)
    syllables = ["ka", "ro", "min", "tel", "an", "é", "x", "room ", "Lab "]
    names = sorted({"".join(r.choice(syllables) for _ in range(r.randrange(1, 6))) for _ in range(150)})
    values = [*names[:20], None, "", "zzz", "  KA ro "]
    for _ in range(120):
        n = list(r.choice(names))
        for _ in range(r.randrange(3)):
            n[r.randrange(len(n))] = r.choice("abxé ")
        values.append("".join(n))
    got = {x["value"]: x["name"] for x in matching.closest(spark.createDataFrame([(v,) for v in values], "value string"), spark.createDataFrame([(n,) for n in names], "name string"), block=block).collect()}
    assert set(got) == set(values) - {None}
    for v, n in got.items():
        assert n == get_close(v, names), v


def test_bounds_rule_out_most():
    r = random.Random(1)
    known = matching.Known(["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(12)) for _ in range(5000)])
    ratio, name, tried = known.best(known.keys[77][:-1] + "q", 0.72)
    assert name == known.names[77] and tried < 50


def test_nothing_known(spark):
    none = spark.createDataFrame([], "name string")
    assert [tuple(x) for x in matching.closest(spark.createDataFrame([("a",)], "value string"), none).collect()] == [("a", None, None)]
