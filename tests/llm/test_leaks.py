"""Problem 9."""
import random

import pytest

from silexa.llm import leaks


def test_words():
    assert leaks.words_of("<b>Café</b> a&amp;b [quote=x]l­a​ter[/quote] x_y 12.5") == ["café", "a", "b", "later", "x", "y", "12", "5"]


def make(seed, n_items=25, n_docs=200):
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) for _ in range(400)]
    text = lambda n: [rng.choice(vocab) for _ in range(n)]
    items = [(i, " ".join(text(rng.randrange(14, 60)))) for i in range(n_items)]
    docs = []
    for d in range(n_docs):
        words = text(rng.randrange(0, 300))
        if d % 3 == 0:
            src = rng.choice(items)[1].split()
            n = rng.choice([8, 11, 12, 13, len(src)])
            at = rng.randrange(0, max(1, len(src) - n + 1))
            part = src[at : at + n]
            if d % 2:
                part = [f"<i>{w}</i>" if rng.random() < 0.2 else w.upper() for w in part]
            k = rng.randrange(0, len(words) + 1)
            words[k:k] = part
        docs.append((d, ", ".join(words)))
    return docs, items


def brute(docs, items, n):
    grams = {}
    for i, t in items:
        w = leaks.words_of(t or "")
        for k in range(len(w) - n + 1):
            grams.setdefault(tuple(w[k : k + n]), set()).add(i)
    out = set()
    for d, t in docs:
        w = leaks.words_of(t or "")
        for k in range(len(w) - n + 1):
            out |= {(d, i) for i in grams.get(tuple(w[k : k + n]), ())}
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_exact_runs_against_brute_force(spark, seed):
    docs, items = make(seed)
    docs += [(9001, None), (9002, ""), (9003, ", ".join(["filler"] * 30_000 + items[0][1].split()))]
    items += [(901, None), (902, "too short")]
    df = spark.createDataFrame([(d, t, "x") for d, t in docs] + [(*docs[0], "y")], "doc_id bigint, text string, i string")
    it = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id bigint, text string, k int")
    out = leaks.leaked_passages(df, "doc_id", "text", it, "item_id", "text", 12).collect()
    got = {(r["doc_id"], r["item_id"]) for r in out if r["exact"]}
    assert got == brute(docs, items, 12) and (9003, 0) in got
    assert len(out) == len({(r["doc_id"], r["item_id"]) for r in out})


def test_changed_words_are_found_but_not_exact(spark):
    words = [f"word{i}letters" for i in range(30)]
    changed = words.copy()
    for k in (5, 12, 19, 26):
        changed[k] = changed[k][:-1]  # a letter lost: no run of 12 is left
    df = spark.createDataFrame([(1, " ".join(changed)), (2, " ".join(words[10:22])), (3, "nothing of it")], "doc_id int, text string")
    it = spark.createDataFrame([(7, " ".join(words))], "item_id int, text string")
    out = {r["doc_id"]: r["exact"] for r in leaks.leaked_passages(df, "doc_id", "text", it, "item_id", "text", 12).collect()}
    assert out == {1: False, 2: True}


def test_several_passes(spark, monkeypatch):
    """The result doesn't depend on how the items are cut, nor on other items: one of short words leaves the others their edits."""
    docs, items = make(8)
    docs = [(d, t.replace("e", "x", 1) if d % 2 else t) for d, t in docs]
    items.append((99, " ".join("ab" for _ in range(14))))
    df, it = spark.createDataFrame(docs, "d bigint, t string"), spark.createDataFrame(items, "i bigint, t string")
    find = lambda it: {tuple(r) for r in leaks.leaked_passages(df, "d", "t", it, "i", "t", 12).collect()}
    once = find(it)
    assert {(r[0], r[1]) for r in once if r[2]} == brute(docs, items, 12) and any(not r[2] for r in once)
    assert find(it.filter("i <> 99")) == {r for r in once if r[1] != 99}
    monkeypatch.setattr(leaks, "HITS", 50)
    monkeypatch.setattr(leaks, "ITEMS", 3)
    assert find(it) == once
    monkeypatch.setattr(leaks, "ITEM_CHARS", 500)
    assert find(it) == once


def near(text, item, most):
    """Whether some window of the text lies within `most` edits of some run of 12 words of the item."""
    w = item.split()
    for r in {" ".join(w[k : k + 12]) for k in range(len(w) - 11)}:
        last = [0] * (len(text) + 1)
        for i, c in enumerate(r, 1):
            now = [i]
            for j, e in enumerate(text, 1):
                now.append(min(last[j] + 1, now[-1] + 1, last[j - 1] + (c != e)))
            last = now
        if min(last) <= most:
            return True
    return False


def test_edited_passages_against_brute_force(spark):
    """Every passage of 12 words within the edit budget is found."""
    rng = random.Random(4)
    vocab = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(4, 9))) for _ in range(300)]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(16))) for i in range(5)]
    docs = []
    for d in range(30):
        w = items[d % 5][1].split()
        part = list(" ".join(w[d % 4 : d % 4 + 12]))
        for _ in range(d % 3):
            part[rng.randrange(len(part))] = rng.choice("xyz")
        docs.append((d, " ".join(rng.choice(vocab) for _ in range(10)) + " " + "".join(part) + " " + rng.choice(vocab)))
    df, it = spark.createDataFrame(docs, "d bigint, t string"), spark.createDataFrame(items, "i bigint, t string")
    got = {(r["d"], r["i"]) for r in leaks.leaked_passages(df, "d", "t", it, "i", "t", 12).collect()}
    want = {(d, i) for d, t in docs for i, x in items if near(t, x, leaks.EDITS)}
    assert len(want) == 30 and want <= got


def test_empty_tables(spark):
    d, i = spark.createDataFrame([], "d bigint, t string"), spark.createDataFrame([], "i bigint, t string")
    one = spark.createDataFrame([(1, "some text")], "d bigint, t string")
    assert leaks.leaked_passages(d, "d", "t", i, "i", "t").count() == 0
    assert leaks.leaked_passages(one, "d", "t", i, "i", "t").count() == 0
    with pytest.raises(ValueError):
        leaks.leaked_passages(one, "d", "t", i, "i", "t", 3)
