from __future__ import annotations

import re
from collections import Counter, defaultdict

import pytest
from llm_fixtures import awkward, documents, sentence  # noqa: F401

import tallyloom.llm.line_templates as line_templates
from tallyloom.llm.line_templates import drop_recurring_lines


def expected(pairs):
    """By the definition, in plain Python: remaining text of each row."""
    def tokens(line):
        words = [w for w in re.sub(r"[\x20\x09-\x0D]+", " ", line).strip(" ").split(" ") if w]
        masked = ["<*>" if re.search("[0-9]", w) else w for w in words]
        characters = ["<*>" if c in "0123456789" else c for c in "".join(words)]
        if sum(w != "<*>" for w in masked) >= 3:
            return ("w", *masked)
        if sum(c != "<*>" for c in characters) >= 20:
            return ("c", *characters)
        return ("s", " ".join(words)) if words else ()

    owners, leaves = defaultdict(set), defaultdict(set)
    for doc_id, text in pairs:
        for line in (text or "").split("\n"):
            t = tokens(line)
            if doc_id is not None and text is not None and t:
                owners[t].add(doc_id)
                leaves[len(t), t[:4]].add(t)
    template = {}
    for leaf, lines in leaves.items():
        held, rests = defaultdict(set), defaultdict(set)
        if len(lines) == 1:
            template[next(iter(lines))] = next(iter(lines))
            continue
        for t in lines:
            for p in range(4, len(t)):
                held[p, t[p]].add(t)
                rests[p, t[:p] + t[p + 1 :]].add(t)

        def several(some):
            return len(some) > 1 and len(set().union(*(owners[t] for t in some))) > 1

        for t in lines:
            constant = [
                (p, t[p]) for p in range(4, len(t)) if several(held[p, t[p]]) and not several(rests[p, t[:p] + t[p + 1 :]])
            ]
            n = len(t) - 1
            template[t] = (leaf, tuple(constant)) if constant and (len(constant) + 3) * 100 >= 80 * n else t
    first = {}
    for t, ids in owners.items():
        first[template[t]] = min(min(ids), first.get(template[t], min(ids)))
    recurs = Counter()
    for key in {template[t] for t in owners}:
        recurs[key] = len(set().union(*(ids for t, ids in owners.items() if template[t] == key)))
    out = []
    for doc_id, text in pairs:
        if doc_id is None or text is None:
            out.append((doc_id, text))
            continue
        kept = []
        for line in text.split("\n"):
            t = tokens(line)
            if not (t and recurs[template[t]] > 1 and first[template[t]] != doc_id):
                kept.append(line)
        out.append((doc_id, "\n".join(kept)))
    return sorted(out, key=str)


def found(df, **options):
    return sorted([(r.doc_id, r.text) for r in drop_recurring_lines(df, **options).collect()], key=str)


BASE = sentence(7, 20).split(" ")


def variant(*changes):
    words = list(BASE)
    for at in changes:
        words[at] = f"changed{'abcdefghij'[at % 10]}"
    return " ".join(words)


PAIRS = [
    (1, "\n".join(["own one line here", "posted on 2020-01-02 by someone", " ".join(BASE)])),
    (2, "\n".join(["Posted on 2021 by", "posted  on\t1999 by someone", variant(10)])),
    (3, "\n".join(["two words", variant(5, 6, 7), "ends \x85 here again"])),
    (4, "\n".join(["two words", variant(4, 8, 12, 13, 14, 15, 16, 17), ""])),
    (5, "same same line in here\nsame same line in here"),
    (6, "1 2 3 4 5\n1 2 3 4 5 six"),
    (7, "9 8 7 6 5\n9 8 7 6 5 six\nsame same line in here"),
    (8, variant(11)),
    (9, "the field of anna is red and it always was"),
    (10, "kept\nthe field of berta is red and it always was"),
    (11, "the field of carla is red and it always was"),
    # Each value in two documents.
    *[(20 + 2 * k + c, f"own words {'abc'[k] * 3}{'xy'[c] * 3} here now\nthe page was last changed by {who} in the old part of town") for k, who in enumerate(("anna", "berta", "carla")) for c in (0, 1)],
    # A passage in many documents and once with another word.
    *[(40 + i, f"body text of number {'abcdefgh'[i]} alone\n{' '.join(BASE[:15])} end of it") for i in range(8)],
    (50, " ".join([*BASE[:7], "other", *BASE[8:15], "end of it"])),
    # No spaces; short lines; numbers.
    (60, "本网站的所有内容均受著作权法保护未经许可不得转载使用\nMenu"),
    (61, "本网站的所有内容均受著作权法保护未经许可不得转载使用\nMenu\nCheese 9.10"),
    (62, "本网站的所有内容均受版作权法保护未经许可不得转载使用\nCheese 9.10\nHam 3.30"),
    (63, "Preise\nCheese 9.10\nBio Honig"),
]


@pytest.mark.parametrize("limit", [0, 200_000])
def test_templates_against_the_definition(documents, monkeypatch, limit):  # noqa: F811
    monkeypatch.setattr(line_templates, "BROADCAST_LEAVES", limit)
    assert found(documents(PAIRS)) == expected(PAIRS)
    kept = dict(found(documents(PAIRS)))
    assert kept[1] == PAIRS[0][1] and "by someone" not in kept[2]
    assert kept[9] == PAIRS[8][1] and kept[10] == "kept" and kept[11] == ""
    assert sum("last changed by" in t for t in kept.values()) == 1 and "last changed by anna" in kept[20]
    assert kept[50] == "" and sum(BASE[3] in t and "end of it" in t for t in kept.values()) == 1
    assert kept[61] == "Cheese 9.10" and kept[62] == "Ham 3.30" and kept[63] == "Preise\nBio Honig"


def test_awkward_rows(awkward):  # noqa: F811
    pairs = [(r.doc_id, r.text) for r in awkward.collect()]
    assert found(awkward) == expected(pairs)
    assert drop_recurring_lines(awkward, count_col=None).columns == awkward.columns
    assert drop_recurring_lines(awkward.limit(0)).count() == 0


def test_emptied_documents_may_go(documents):  # noqa: F811
    pairs = [(1, "a line of text"), (2, "a line of text"), (3, ""), (4, "a line of text\nand more of it"), (2, "another text for two")]
    pairs += [(5, "Yes.\na line of text\nNo."), (6, "Yes.\nNo."), (7, "a line of text\nCheese 9.10\nHam 3.30")]
    kept = dict(found(documents(pairs), drop_emptied=True))
    assert sorted(kept) == [1, 2, 3, 4, 5, 7] and kept[7] == "Cheese 9.10\nHam 3.30" and kept[5] == "Yes.\nNo."


def test_counts(documents):  # noqa: F811
    got = {r.doc_id: r.n_lines_dropped for r in drop_recurring_lines(documents(PAIRS)).collect()}
    assert got[1] == 0 and got[7] == 1
