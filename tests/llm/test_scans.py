import random

import rxloom.llm.scans as scans
from rxloom.llm.scans import Vocabulary, page_number, repair, undo

SENTENCES = [
    "Treatment with the sterile solution should be monitored in elderly patients.", "The committee asked why headache had been recorded in children under twelve years.", "Store the glass vials between 15 and 30 degrees and out of the reach of children.",
    "Long-term experience with film-coated tablets is limited to healthy volunteers.", "The applicant submitted additional stability data in support of the product.",
]


def pages(seed=1, monographs=40, n=4):
    rng = random.Random(seed)
    out, page_id = [], 0
    for m in range(monographs):
        name = "".join(rng.choice(["ZA", "KO", "LU", "MI"]) for _ in range(4)) + "XO"
        for p in range(n):
            words = " ".join(rng.choice(SENTENCES) for _ in range(6)).split()
            lines, line = [], ""
            for w in words:
                if len(line) + len(w) > 55:
                    lines.append(line.strip())
                    line = ""
                line += w + " "
            page_id += 1
            out.append([page_id, m, p + 1, [f"{name} Product Monograph", "", *lines, line.strip(), f"[{p + 1}]"]])
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, m, p, "\n".join(t) if isinstance(t, list) else t, "x") for i, m, p, t in rows], "page_id long, monograph_id long, page int, text string, word string")


def test_planted_defects(spark):
    rows = pages()
    want = {(r[0], k + 1, "running_line", "") for r in rows for k in (0, len(r[3]) - 1)}
    t = rows[8][3]
    t[3:3] = ["the ster-", "ile solution of pat-"]
    nxt = rows[8][3][5]
    t[5] = "ients " + nxt
    want |= {(9, 4, "hyphen_break", "sterile"), (9, 5, "hyphen_break", "patients")}
    rows[12][3].insert(3, "wirh film-")
    rows[12][3].insert(4, "coated tab1ets and chi|dren of rnonitored")
    want |= {(13, 4, "hyphen_break", "film-coated"), (13, 5, "char_error", "tablets"), (13, 5, "char_error", "children"), (13, 5, "char_error", "monitored")}
    t, after = rows[16][3], rows[17][3]
    t.insert(len(t) - 1, "in support of the prod‐")
    after.insert(2, "uct and the")
    want |= {(17, len(t) - 1, "hyphen_break", "product")}
    fixed = {(r[0], k + 1) for r in rows for k in (0, len(r[3]) - 1)}
    want = {x for x in want if x[2] != "running_line"} | {(i, k, "running_line", "") for i, k in fixed}
    got = {tuple(r) for r in repair(frame(spark, rows)).collect()}
    assert got == want


def test_blocks_change_nothing(spark, monkeypatch):
    df = frame(spark, pages(seed=3))
    whole = sorted(map(tuple, repair(df).collect()))
    monkeypatch.setattr(scans, "BLOCK", 8)
    assert sorted(map(tuple, repair(df).collect())) == whole


def test_twins_nulls_and_empty(spark):
    rows = pages(seed=4)
    rows.append([500, 39, 4, list(rows[-1][3])])
    rows += [[600, 70, 1, None], [601, 70, 2, ""], [602, 70, 3, "  \n "], [603, None, None, "x"]]
    got = repair(frame(spark, rows))
    assert got.where("page_id >= 600").count() == 0
    a = {tuple(r)[1:] for r in got.where("page_id = 160").collect()}
    assert a and a == {tuple(r)[1:] for r in got.where("page_id = 500").collect()}
    assert repair(frame(spark, rows).limit(0)).count() == 0
    assert repair(frame(spark, rows[-4:-1])).count() == 0


def test_paragraphs(spark):
    rows = pages(seed=5)
    rows[0][3][2:-1] = ["The ster-", "ile solution should be", "", "used in pat-"]
    rows[1][3][2:2] = ["ients with chi|dren."]
    text = [r.text for r in repair(frame(spark, rows), paragraphs=True).where("monograph_id = 0").orderBy("page_id", "line_no").collect()]
    assert text[0] == "The sterile solution should be"
    assert text[1].startswith("used in patients with children.")
    assert not any("Monograph" in t or "[1]" in t for t in text)


def test_helpers():
    v = Vocabulary.of({"monitored": 500, "the": 5000, "tbe": 100, "bottle": 40})
    assert "tbe" not in v.counts and v.right("tbe") == "the" and v.right("rnonitored") == "monitored"
    assert undo("6ott|e", lambda w: w == "bottle")[0] == "bottle"
    assert [page_number(x) for x in ("[12]", "- 7 -", "Page 3 of 9", "p. 4", "10/21", "12 mg", "l2", "Table")] == [12, 7, 3, None, 10, None, 12, None]


def test_page_numbers_are_sequences(spark):
    rows = pages(seed=6, monographs=12, n=5)
    lone = rows[2][3]
    lone[-1:] = ["1000"]  # a value of a table at the edge of a page
    rows[3][3][-1] = "[9]"  # 4, with its digit misread
    got = {(r.page_id, r.line_no) for r in repair(frame(spark, rows)).where("defect = 'running_line'").collect()}
    assert (3, len(lone)) not in got and (4, len(rows[3][3])) in got and (5, len(rows[4][3])) in got and (1, len(rows[0][3])) in got
    from rxloom.llm.scans import Monograph

    one = Monograph([1], [7], ["25\ntext of a page\n7"], Vocabulary({}), set(), set())
    assert one.run == [{2}]
    shifted = Monograph([1, 2, 3], [1, 2, 3], ["first text here\n11", "another and longer line\n12", "what comes last of all\n40"], Vocabulary({}), set(), set())
    assert [sorted(x) for x in shifted.run] == [[1], [1], []]


def test_counts_do_not_depend_on_batches(spark):
    from rxloom.llm.scans import counted, words_of

    rows = [r for r in pages(seed=7, monographs=9)]
    rows[0][3].append("a word bro-")
    df = frame(spark, rows)
    got = counted(df)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        assert counted(df.repartition(5)) == got
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    counts, where = {}, {}
    for _, m, _, lines in rows:
        for line in lines:
            w = words_of(line)
            for x in w[:-1] if w and line.rstrip()[-1] in "-‐‑" else w:
                counts[x] = counts.get(x, 0) + 1
                where.setdefault(x, set()).add(m)
    assert got == ({w: n for w, n in counts.items() if n >= 3}, {w for w, n in counts.items() if n >= 3 and len(where[w]) >= 5})
