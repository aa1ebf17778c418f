import random

from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F
from rxloom.llm.names import firm_pairs, link_names, parse_name, trie_join
from rxloom.llm.tries import BOUND, Trie, allowed, segments, substrings


def osa(a, b):
    d = [[i + j if i * j == 0 else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[len(a)][len(b)]


WORD = st.text("ABC", min_size=2, max_size=9)


@settings(max_examples=150, deadline=None)
@given(st.lists(WORD, min_size=1, max_size=12, unique=True), WORD)
def test_automaton_and_shards_are_exact(words, query):
    t = Trie()
    for w in words:
        t.add(w, w)
    near = {w: osa(query, w) for w in words if osa(query, w) <= BOUND}
    assert dict(t.within(query, BOUND)) == near
    for w, distance in near.items():
        assert distance > allowed(query, w) or set(segments(w)) & substrings(query), (query, w)


def test_trie_join_against_brute_force(spark, monkeypatch):
    import rxloom.llm.names as names

    monkeypatch.setattr(names, "INDEX_SHARD", 7)
    monkeypatch.setattr(names, "QUERY_SHARD", 11)
    rng = random.Random(3)
    base = ["".join(rng.choice("ABCDEFG") for _ in range(rng.randint(4, 8))) + "WICK" * rng.randint(0, 1) for _ in range(60)]
    keys = sorted({*base, *(b[: (i := rng.randrange(len(b)))] + rng.choice("AXY") + b[i + 1 :] for b in base)})
    df = spark.createDataFrame([(k, [k]) for k in keys], "key string, orders array<string>")
    got = {(r.a, r.b): r.distance for r in trie_join(df, 3).collect()}
    assert got == {(a, b): osa(a, b) for a in keys for b in keys if a != b and osa(a, b) <= allowed(a, b)}


NAMES = [
    (1, "JAMES GENGUKO BIOLOGICS CANADA INC."), (2, "GENGUKO, JIM BIOLOGIQUES, CANADA INC"), (3, "James Gnguko Biologics Canada Inc"), (4, "JGB CANADA INC."), (5, "J. GENGUKO BIOL. CDN INCORPORATED"),
    (6, "JAMES GENGUKO VACCINES CANADA INC."), (7, "DASHONIS & FISZOV PHARMACEUTICALS ATLANTIC LP"), (8, "FISZOV AND DASHONIS PHARMA ATLANTIC LP"), (9, "DASHONISFISZOV PHARMACEUTICALS ATLANTIC"),
    (10, "DASHONIS & FISZOV ATLANTIC LP"), (11, "Dashonis & Fizsov Pharmaceuticals Atlantic LP"), (12, None), (13, " "), (14, "TORDON LABORATORIES CANADA CORP."), (15, "TORDON LABORATORIES CANADA CORP."), (16, "QQX LTD"),
]


def test_links(spark):
    df = spark.createDataFrame([(*r, "x") for r in NAMES], "name_id long, spelling string, firm string")
    linked = link_names(df, len(NAMES))
    firm = {r.name_id: r.firm for r in linked.collect()}
    assert [firm[i] for i in range(1, 6)] == [1] * 5 and firm[6] == 6
    assert {firm[i] for i in range(7, 12)} == {7}
    assert firm[14] == firm[15] == 14 and firm[16] == 16 and 12 not in firm and 13 not in firm
    pairs = {(r.name_id_a, r.name_id_b) for r in firm_pairs(linked).collect()}
    assert (1, 4) in pairs and all(a < b for a, b in pairs)
    assert link_names(df.where(F.lit(False)), 0).count() == 0


def test_parts():
    p = parse_name("HENRIETTA WIKWIN SOINS DE SANTÉ N. AMERICA S.E.C.")
    assert (p["key"], p["given"], p["business"], p["region"], p["legal"]) == ("WIKWIN", "HENRIETTA", "HEALTHCARE", "NORTHAMERICA", "SEC")
    assert parse_name("H.F.L. GLOBAL CORP.")["acronym"] == "HFL"
    assert parse_name("WILLIAM LABS")["key"] == "WILLIAM"


def test_long_names(spark):
    words = "TORDON WIKWIN GENGUKO DASHONI FISZOV BELQUAR".split()
    rows = [(1, " ".join(words)), (2, " ".join([words[k] for k in (3, 0, 5, 1, 4, 2)])), (3, " ".join([*words[:5], "ZURMATH"])), (4, " ".join(["XTORDON", *words[:0:-1]])), (5, " ".join(words[:5])), (6, " ".join([words[k] for k in (2, 4, 0, 1, 3)]))]
    keys = {i: min(parse_name(t)["orders"]) for i, t in rows}
    assert keys[1] == keys[2] != keys[3] and keys[5] == keys[6] and len(set(keys.values())) == 4
    df = spark.createDataFrame([(k, parse_name(t)["orders"]) for k, t in {keys[i]: t for i, t in rows if i != 2}.items()], "key string, orders array<string>")
    assert {(r.a, r.b): r.distance for r in trie_join(df, 2).collect()} == {(keys[1], keys[4]): 1, (keys[4], keys[1]): 1}


def test_long_ways_up_end(spark):
    """A chain of spellings, each two errors from the next and more frequent one, is one firm."""
    rows, word = [], "KALIMORENTAVUS"
    for step in range(7):
        rows += [f"{word} LABORATORIES CANADA INC."] * 4**step
        word = word[: 2 * step] + "XY"[step % 2] * 2 + word[2 * step + 2 :]
    df = spark.createDataFrame(list(enumerate(rows)), "name_id long, spelling string")
    assert link_names(df, len(rows)).select("firm").distinct().count() == 1


def test_links_never_lead_back(spark):
    """The same letters in another order, and an error apart: by number of the name and by spelling alone these would be a circle."""
    rows = [(13254, "GIRUNSEN VIKWOXO BIOLOGICS LP"), (32364, "GIRNUSEN VIKWOXO BIOLOGICS LP"), (16995, "VIKWOXOGIRNUSEN BIOLOGICS LP")]
    firms = {r.name_id: r.firm for r in link_names(spark.createDataFrame(rows, "name_id long, spelling string"), 3).collect()}
    assert firms == dict.fromkeys((13254, 32364, 16995), 13254)
