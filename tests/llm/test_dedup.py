"""Near-duplicates, line dedup and substring dedup against brute force."""

import random
import re

import duckdb
import numpy as np
import pytest
from fixtures import LONG, awkward, texts

from tickloom.llm import linededup, neardup, substring
from tickloom.llm import queries as Q
from tickloom.llm.common import Words
from tickloom.llm.graph import components

SF = "/root/testdata/sf0.001"
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(FOLD))


def union(pairs, nodes):
    parent = {x: x for x in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return {x: find(x) for x in nodes}


def brute_neardup(docs, width, percent=80):
    sets = {}
    for i, t in docs.items():
        w = words_of(t)
        sets[i] = set() if not w else {tuple(w)} if len(w) < width else {tuple(w[k : k + width]) for k in range(len(w) - width + 1)}
    ids = sorted(docs)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    return {i: (i, len(sets[i]), c, c == i) for i, c in union(links, ids).items()}


def group_of_copies(n, seed=0):
    """Copies of one text, each with its own small changes, so that many pairs of them are not similar; a chain; exact copies."""
    r = random.Random(seed)
    base = [f"w{r.randrange(10**6)}" for _ in range(200)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(r.randrange(0, 9)):
            w[r.randrange(len(w))] = f"x{r.randrange(10**6)}"
        out.append(" ".join(w))
    chain = list(base)
    for k in range(0, 200, 4):
        chain = [*chain[:k], f"c{k}", *chain[k + 1 :]]
        out.append(" ".join(chain))
    out += [out[3]] * 4 + [" ".join(f"u{r.randrange(10**6)}" for _ in range(50)) for _ in range(20)]
    r.shuffle(out)
    return out


def test_neardup_query(spark):
    docs = texts()
    assert {r.doc_id: tuple(r) for r in Q.op1(spark, SF).collect()} == brute_neardup(docs, 4)


def test_neardup_of_large_groups_and_awkward_rows(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 8)
    docs = dict(enumerate(group_of_copies(60)))
    docs |= {900: None, 901: "", 902: " \n", 903: "One two", 904: "one\tTWO", 905: "one two three", 906: LONG, 907: LONG + " end"}
    rows = [*docs.items(), (3, docs[3])]
    got = neardup.near_duplicates(awkward(spark, [*rows, (None, docs[3])]), words=4).collect()
    want = brute_neardup(docs, 4)
    assert {r.doc_id: tuple(r) for r in got if r.doc_id is not None} == want and len(got) == len(rows) + 1
    assert [(r.component_id, r.kept) for r in got if r.doc_id is None] == [(None, True)]


def test_neardup_empty(spark):
    assert not neardup.near_duplicates(awkward(spark, [(1, "a")]).filter("doc_id = 2")).count()


def test_pruning_keeps_what_the_miss_probability_allows():
    least = neardup.least_matches(0.8, 1e-6)
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**32, (4000, neardup.SIZE), dtype=np.uint32)
    b = np.where(rng.random(a.shape) < 0.8, a, a + 1)
    assert neardup.plausible(a, b, least).all()
    assert not neardup.plausible(a, np.where(rng.random(a.shape) < 0.3, a, a + 1), least).any()


def test_components_of_a_long_chain_and_a_star(spark):
    links = [(k, k + 1) for k in range(0, 300)] + [(1000, 1000 + k) for k in range(1, 200)] + [(7, 7)]
    random.Random(4).shuffle(links)
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(301)}, **{1000 + k: 1000 for k in range(200)}}
    assert not components(spark.createDataFrame([], "a long, b long")).count()


# --- lines ---------------------------------------------------------------------------------------------------------------


def brute_lines(rows, run, words=24):
    """rows in order of (doc_id, anything): texts without the lines of runs that begin earlier too, a line of so many words being a run."""
    seen, out = set(), []
    for t in rows:
        lines = (t or "").split("\n")
        at = [i for i, x in enumerate(lines) if x.strip(" \t\r")]
        body = [lines[i].strip(" \t\r") for i in at]
        gone = set()
        for k in range(len(body) - run + 1):
            key = tuple(body[k : k + run])
            if key in seen:
                gone.update(at[k : k + run])
            seen.add(key)
        for i, line in zip(at, body, strict=True):
            if len(words_of(line)) >= words:
                if (line,) in seen:
                    gone.add(i)
                seen.add((line,))
        out.append(None if t is None else "\n".join(x for i, x in enumerate(lines) if i not in gone))
    return out


def test_line_dedup_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    assert sorted(map(tuple, Q.op2(spark, SF).collect())) == sorted(con.execute(Q.ORACLE["op2_line_dedup"]).fetchall())


@pytest.mark.parametrize("run", [1, 2, 3])
def test_line_dedup_brute_force(spark, run):
    r = random.Random(run)
    rows = [(i, "\n".join(r.choice(["a", "b", " a ", "", "c", "d\r", "e", "f", str(r.random())]) for _ in range(r.randrange(0, 14)))) for i in range(80)] + [(90, None), (91, ""), (92, "a\nb\n" * 500)]
    df = awkward(spark, [*rows, (None, "a\nb\na\nb")])
    out = linededup.dedup_lines(df, run).collect()
    got = {x.doc_id: x.text for x in out}
    assert [got[i] for i, _ in rows] == brute_lines([t for _, t in rows], run) and got[None] == "a\nb\na\nb"
    assert {c for c in df.columns} <= set(out[0].asDict()) and all(x.key == "x" for x in out)


def test_line_dedup_of_single_long_lines(spark):
    long, short = " ".join(f"w{i}" for i in range(24)), " ".join(f"w{i}" for i in range(23))
    rows = [(1, f"a\n{long}\nb"), (2, f"c\n {long}\t\nd\n{short}"), (3, long), (4, f"e\n{short}\nf"), (5, f"{long}\ng\n{long}"), (6, "h\n" + long.replace(" ", "\u00a0"))]
    rows += [(7, "h\n" + long.replace(" ", "\u00a0") + "\ni"), (8, "\x0b".join(long.split())), (9, "j\n" + "\x0b".join(long.split()))]
    out = linededup.dedup_lines(awkward(spark, rows)).collect()
    got = {x.doc_id: x.text for x in out}
    assert [got[i] for i, _ in rows] == brute_lines([t for _, t in rows], 2)
    assert got[1] == rows[0][1] and got[2] == f"c\nd\n{short}" and got[3] == "" and got[4] == rows[3][1] and got[5] == "g" and got[9] == "j"
    few = {x.doc_id: x.text for x in linededup.dedup_lines(awkward(spark, rows), words=23).collect()}
    assert few[4] == "e\nf" and [few[i] for i, _ in rows] == brute_lines([t for _, t in rows], 2, 23)


def test_line_dedup_repeated_rows_and_empty_table(spark):
    out = linededup.dedup_lines(awkward(spark, [(1, "a\nb\nc"), (1, "a\nb\nc"), (2, "x\na\nb")])).collect()
    assert sorted((x.doc_id, x.text) for x in out) == [(1, "a\nb\nc"), (1, "a\nb\nc"), (2, "x")]
    out = linededup.dedup_lines(awkward(spark, [(1, "a\nb\nc"), (1, "a\nb\nd")])).collect()
    assert sorted(x.text for x in out) in (["a\nb\nc", "d"], ["a\nb\nd", "c"])
    assert not linededup.dedup_lines(awkward(spark, [(1, "a")]).filter("doc_id = 2")).count()


# --- passages ------------------------------------------------------------------------------------------------------------


def brute_spans(docs):
    """Of each document the character spans to remove, by the definition, unit by unit."""
    made = []
    for i in sorted(docs):
        text = docs[i]
        at = [(m.start(), m.end()) for m in re.finditer(r"[^\x20\x09-\x0D]+", text)]
        body = words_of(text)
        rank = substring.mix(Words([text]).hash ^ np.uint64(0xA5A5A5A5A5A5A5A5)).tolist()
        starts = {min(range(k, k + substring.STRETCH), key=lambda p: (rank[p], p)) for k in range(len(body) - substring.STRETCH + 1)}
        units = {(s, s + substring.PARAGRAPH) for s in starts if s + substring.PARAGRAPH <= len(body)}
        line = [text.count("\n", 0, a) for a, _ in at]
        for n in set(line):
            own = [k for k, x in enumerate(line) if x == n]
            if len(own) >= substring.PARAGRAPH:
                units.add((own[0], own[-1] + 1))
        made += [(i, at[a][0], at[b - 1][1], tuple(body[a:b])) for a, b in units]
    first = {}
    for i, a, b, unit in sorted(made):
        first.setdefault(unit, (i, a, b))
    gone = {i: set() for i in docs}
    for i, a, b, unit in made:
        f = first[unit]
        if not (i == f[0] and a < f[2]):
            gone[i].update(range(a, b))
    return gone


def test_substring_dedup_brute_force(spark):
    r = random.Random(3)
    word = lambda: r.choice(["the", "of", "and", *[f"w{r.randrange(10**5)}" for _ in range(5)]])
    passage = [[word() for _ in range(n)] for n in (51, 70, 30, 23)]
    docs = {}
    for i in range(40):
        w = [word() for _ in range(r.randrange(0, 200))]
        for p in r.sample(passage, r.randrange(0, 3)):
            k = r.randrange(len(w) + 1)
            w = w[:k] + [x.title() if r.random() < 0.2 else x for x in p] + w[k:]
        docs[i] = "".join(x + r.choice([" ", " ", "  ", "\n", " é "]) for x in w)
    docs |= {50: "", 51: "in " * 300, 52: docs[5], 53: "Ä " * 60, 54: "\n".join([" ".join(f"q{k}" for k in range(30))] * 3)}
    want = brute_spans(docs)
    df = awkward(spark, [*docs.items(), (60, None), (None, docs[5])])
    out = {x.doc_id: x for x in substring.dedup_substrings(df).collect()}
    for i, t in docs.items():
        assert out[i].text == "".join(c for k, c in enumerate(t) if k not in want[i]), i
    assert out[60].text is None and out[None].text == docs[5] and out[0].key == "x"
    for x in substring.removed_spans(df).collect():
        assert set(range(x.start, x.end)) <= want[x.doc_id] | {k for k in range(x.start, x.end) if docs[x.doc_id][k].isspace()}
        n = len(words_of(docs[x.doc_id][x.start : x.end]))
        assert words_of(docs[x.kept_doc_id][x.kept_start :])[:n] == words_of(docs[x.doc_id][x.start : x.end])
    for p in passage[:2]:  # long passages stay once at most
        assert sum(" ".join(p).lower() in " ".join(words_of(x.text)) for x in out.values() if x.doc_id is not None) <= 1


def test_substring_dedup_repeated_rows_and_empty_table(spark):
    t = " ".join(f"w{k}" for k in range(60))
    out = substring.dedup_substrings(awkward(spark, [(1, t), (1, t), (2, "x " + t)])).collect()
    assert sorted((x.doc_id, len(x.text)) for x in out)[:2] == [(1, len(t))] * 2 and len(out[-1].text) < len(t)
    none = awkward(spark, [(1, "a")]).filter("doc_id = 2")
    assert not substring.dedup_substrings(none).count() and not substring.removed_spans(none).count()


def test_every_repeated_run_goes_to_its_borders(spark, monkeypatch):
    monkeypatch.setattr(substring, "STRETCH", 1)  # for brute_spans() only: units begin at every word
    r = random.Random(8)
    word = lambda: r.choice(["the", "of", *[f"w{r.randrange(10**5)}" for _ in range(6)]])
    passage = [[word() for _ in range(n)] for n in (51, 39, 38, 30, 25, 24, 23)]
    passage.append(passage[0][10:45] + [word() for _ in range(20)])
    docs = {}
    for i in range(60):
        w = [word() for _ in range(r.randrange(0, 120))]
        for p in r.sample(passage, r.randrange(0, 4)):
            k = r.randrange(len(w) + 1)
            w = w[:k] + p[r.randrange(3) :] + w[k:]
        docs[i] = "".join(x + r.choice([" ", " ", "\n", "é "]) for x in w) if i % 2 else " ".join(w)
    docs |= {70: "", 71: "in " * 300, 72: docs[4], 73: "a b c " * 40, 74: "x " + docs[6]}
    want = brute_spans(docs)
    out = {x.doc_id: x.text for x in substring.dedup_substrings(awkward(spark, [*docs.items(), (80, None)]), every=True).collect()}
    for i, t in docs.items():
        assert words_of(out[i]) == words_of("".join(c if k not in want[i] else " " for k, c in enumerate(t))), i
    gone = {i: set() for i in docs}
    for x in substring.removed_spans(awkward(spark, [*docs.items()]), every=True).collect():
        gone[x.doc_id].update(range(x.start, x.end))
        n = len(words_of(docs[x.doc_id][x.start : x.end]))
        assert words_of(docs[x.kept_doc_id][x.kept_start :])[:n] == words_of(docs[x.doc_id][x.start : x.end])
    for i, t in docs.items():
        assert {k for k in gone[i] if not t[k].isspace()} == {k for k in want[i] if not t[k].isspace()}, i


def test_substring_query_is_whole(spark, monkeypatch):
    monkeypatch.setattr(substring, "STRETCH", 1)
    docs = texts()
    want, gone = brute_spans(docs), {i: set() for i in docs}
    for x in Q.op10(spark, SF).collect():
        gone[x.doc_id].update(range(x.start, x.end))
    assert {i: {k for k in g if not docs[i][k].isspace()} for i, g in gone.items()} == {i: {k for k in g if not docs[i][k].isspace()} for i, g in want.items()}
