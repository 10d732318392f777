from __future__ import annotations

import random
import re

import pytest

from marlstone.llm import leaks

WORDS = [f"w{k}x" for k in range(4000)]
rng = random.Random(11)


def text(n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


ITEMS = [(k, text(80)) for k in range(1, 21)] + [(30, "".join(rng.choice("的一是在不了有和人这中大为上个国我以要他时来用们生到作地于出就分对成会可主发年动同工也能下过子说产种面而方后多定行学法所民得经") for _ in range(200)))]
DOCS = "doc_id bigint, text string, item_id int, lang string"


def quote(item, start, n, changes=()):
    words = dict(ITEMS)[item].split()[start : start + n]
    for k in changes:
        words[k] = "changed" + str(k)
    return words


def brute(doc, item):
    """The definition on plain words without insertions: some run of 20 or more item words with at most a tenth of others
    in place, not at its ends."""
    d, w = re.findall(r"\w+", doc.lower()), item.split()
    for shift in range(-len(w), len(d)):
        same = [d[j + shift] == x if 0 <= j + shift < len(d) else False for j, x in enumerate(w)]
        if sum(same) >= 18 and any(same[j] and same[j + n - 1] and 10 * (n - sum(same[j : j + n])) <= n for n in range(20, 41) for j in range(len(w) - n + 1)):
            return True
    return False


def found(spark, docs, items=ITEMS, **kw):
    d = spark.createDataFrame([(k, t, 1, "x") for k, t in docs], DOCS)
    i = spark.createDataFrame([(k, t, 2) for k, t in items], "item_id bigint, text string, doc_id int")
    return {tuple(r) for r in leaks.leaked_items(d, i, **kw).collect()}


def test_against_brute_force(spark):
    docs = []
    for k in range(150):
        item, n = rng.randrange(1, 21), rng.choice([10, 15, 19, 20, 21, 25, 40])
        changes = sorted(rng.sample(range(1, n - 1), rng.choice([0, 1, 2, 3])))
        docs.append((k, f"{text(rng.randrange(0, 60))} {' '.join(quote(item, rng.randrange(0, 80 - n), n, changes))} {text(rng.randrange(0, 60))}"))
    want = {(i, k) for k, t in docs for i, x in ITEMS[:20] if set(x.split()) & set(t.split()) and brute(t, x)}
    assert found(spark, docs) == want and len(want) > 50
    assert found(spark, docs, block=7) == want


@pytest.mark.parametrize(
    "change",
    [str.upper, lambda t: t.replace(" ", "\n> "), lambda t: t.replace(" ", ", "), lambda t: t.replace("w", "w\u200b"), lambda t: "".join(chr(ord(c) + 0xFEE0) if "!" <= c <= "~" else c for c in t), lambda t: t.replace(" ", "&nbsp;"), lambda t: " ".join(f"<em>{w}</em>" for w in t.split()), lambda t: t.replace(" ", f' <span class="{"x y " * 105}" id=k> ', 3), lambda t: t.replace(" ", f" <b {'long ' * 84}> ", 2), lambda t: t.replace(" ", f" <!-- {'note ' * 90}--> ", 2), lambda t: re.sub(r"(w\d)(\d+x) ", "\\1-\n\\2 ", t, count=3), lambda t: "```\n// " + t.replace(" ", "\n// ") + "\n```"],
)
def test_disguises(spark, change):
    assert found(spark, [(1, "intro " + change(" ".join(quote(3, 10, 24))) + " end")]) == {(3, 1)}


def test_unspaced(spark):
    zh = dict(ITEMS)[30]
    docs = [(1, zh[20:85]), (2, zh[20:75]), (3, "前" + zh[50:120].replace(zh[60], "X", 1) + "后"), (4, "\u3000".join(zh[10:80])), (5, "\n".join(zh[10:80]))]
    assert found(spark, docs) == {(30, k) for k in (1, 3, 4, 5)}


def test_instructions_and_edges(spark):
    head = "Read the finding below with care and name the one weakness of all those in the list that it describes best today please."
    items = [(k, f"{head} {text(40)}") for k in range(5)] + [(7, None), (8, ""), (None, "x"), (9, "too short")]
    docs = [(1, head), (2, head + " " + " ".join(items[0][1].split()[22:33])), (3, items[1][1]), (4, None), (5, ""), (6, "z" * 300_000), (7, items[1][1] + " " + items[2][1])]
    assert found(spark, docs * 2, items) == {(1, 3), (1, 7), (2, 7)}
    assert found(spark, docs, []) == set() and found(spark, [], items) == set()
