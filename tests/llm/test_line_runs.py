"""Repeated blocks against brute force over all earlier documents."""

import random

from test_line_dedup import sequence

from millrace.llm.line_dedup import MIN_WORDS, runs, without_repeats


def line(name, n):
    return " ".join(f"{name}{i}" for i in range(n))


def brute(rows, min_words=MIN_WORDS):
    """Places of the lines in common blocks with any earlier document."""
    out = {}
    for i, t in rows:
        gone, c = set(), sequence(t)
        for j, u in rows:
            b = sequence(u) if j < i else []
            for x in range(len(b)):
                for y in range(len(c)):
                    if x and y and b[x - 1]["h"] == c[y - 1]["h"]:
                        continue
                    k = 0
                    while x + k < len(b) and y + k < len(c) and b[x + k]["h"] == c[y + k]["h"]:
                        k += 1
                    if sum(z["words"] for z in c[y : y + k]) >= min_words:
                        gone.update(z["place"] for z in c[y : y + k])
        out[i] = gone
    return out


def removed(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in without_repeats(df).collect()}
    want = brute(rows)
    for i, t in rows:
        lines = [x for k, x in enumerate(t.split("\n")) if k not in want[i]]
        assert got[i].n_lines_removed == len(want[i]), i
        assert got[i].text.split("\n") == lines or not "".join(lines).strip()
    return {i: r.n_lines_removed for i, r in got.items()}


def test_runs_cover_every_block():
    r = random.Random(8)
    for _ in range(300):
        words = [r.randint(1, 14) for _ in range(r.randint(0, 14))]
        numbers, at = [], 0
        for _ in words:
            at += 1 + (r.random() < 0.15)
            numbers.append(at)
        found = list(runs(words, numbers))
        straight = lambda a, e: all(numbers[k + 1] == numbers[k] + 1 for k in range(a, e - 1))
        assert all(straight(a, e) and sum(words[a:e]) >= MIN_WORDS for a, e in found)
        for a in range(len(words)):
            for e in range(a + 1, len(words) + 1):
                if straight(a, e) and sum(words[a:e]) >= MIN_WORDS:
                    assert {k for x, y in found if a <= x and y <= e for k in range(x, y)} == set(range(a, e))


def test_block_whose_lines_occurred_singly_before(spark):
    a, b, c = line("a", 11), line("b", 10), line("c", 11)
    rows = [
        (1, f"{a}\n{line('p', 9)}\n{c}"), (2, f"{line('q', 9)}\n{b}"),
        (3, f"{line('r', 9)}\n{a}\n{b}\n{c}\n{line('s', 9)}"), (4, f"{line('t', 9)}\n{a}\n{b}\n{c}\n{line('u', 9)}"),
    ]
    assert removed(spark, rows) == {1: 0, 2: 0, 3: 0, 4: 3}


def test_end_of_a_longer_block(spark):
    a, b, c = line("a", 20), line("b", 15), line("c", 5)
    rows = [(1, f"{a}\n{b}\nx"), (2, f"y\n{a}\n{b}\n{c}"), (3, f"{a}\n{b}\n{c}\nz")]
    assert removed(spark, rows) == {1: 0, 2: 2, 3: 3}


def test_passages_without_unique_lines(spark):
    p = "\n".join(line(k, 18) for k in "abc")
    h, t = line("h", 9), line("t", 9)
    rows = [
        (1, f"{h}\n{t}"), (2, f"{line('x', 9)}\n{p}\n{p}\n{line('y', 9)}"), (3, f"{h}\n{p}\n{t}"), (4, f"{t}\n{p}\n{h}"),
        (5, f"{h}\n{p}\nbetween\n{p}\n{t}"), (6, f"{line('z', 9)}\n{p}\n{t}\n{p}\n{p}"),
    ]
    assert removed(spark, rows) == {1: 0, 2: 0, 3: 3, 4: 3, 5: 8, 6: 10}


def test_random_documents_against_all_earlier_ones(spark):
    r = random.Random(9)
    pool = [line(f"p{k}x", r.randint(1, 25)) for k in range(25)]
    ids = r.sample(range(200), 60)
    rows = [(i, "\n".join(r.choice(pool) for _ in range(r.randint(1, 30)))) for i in ids]
    removed(spark, rows)


def test_short_lines_and_scripts_without_spaces(spark):
    verse = "\n".join(line(f"v{k}x", 4) for k in range(12))
    chinese = "".join(chr(0x4E00 + 7 * k) for k in range(40))
    thai = "\u0e01\u0e34" * 29
    rows = [
        (1, f"one\n{verse}\n{chinese}\n{thai}"), (2, f"two\n{verse}\nend"), (3, f"{chinese}\n\u7532"),
        (4, f"\u4e59\n{chinese[:20]}\n{chinese[20:]}"), (5, f"\u4e19\n{chinese[:20]}\n{chinese[20:]}"), (6, thai), (7, f"six\n{thai}\u0e02"), (8, f"{thai}\u0e02"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = without_repeats(df).collect()
    assert {r.doc_id: r.n_lines_removed for r in got} == {1: 0, 2: 12, 3: 1, 4: 0, 5: 2, 6: 0, 7: 0, 8: 1}
