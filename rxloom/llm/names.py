"""Variant spellings of the names of organisations, linked by a trie join.

A name is read into core tokens, a person's given name, line of business, region and legal form by fixed word lists,
whatever the order of its parts. Core tokens, in every order and without blanks between them, are joined by tries
(rxloom.llm.tries) within a bounded number of typing errors. A rare core is a misspelling of the most frequent near core
of the same line of business; what lacks a line of business or a given name belongs to the only firm that fits it.
Acronyms join by initials, region and legal form where just one firm has them.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterable, Iterator, Sequence
from functools import cmp_to_key, lru_cache
from itertools import permutations

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rxloom.functions.arrow import arrow_schema
from rxloom.llm.tries import Trie, allowed, bound_of, segments, substrings
from rxloom.session import cut, stored

#: Words of each line of business, region and legal form, English and French, with their short forms.
BUSINESS = {
    "BIOLOGICS": "BIOLOGICS BIOLOGIC BIOLOGIQUES BIOLOGIQUE BIOL BIOLOGICALS BIO",
    "LABORATORIES": "LABORATORIES LABORATORY LABORATOIRES LABORATOIRE LABS LAB",
    "HEALTHCARE": "HEALTHCARE HLTHCARE HLTH HEALTH SANTE",
    "THERAPEUTICS": "THERAPEUTICS THERAPEUTIC THERAPEUTIQUES THERAPEUTIQUE THERAP TX THER",
    "PHARMACEUTICALS": "PHARMACEUTICALS PHARMACEUTICAL PHARMACEUTIQUES PHARMACEUTIQUE PHARMA PHARM PHARMS PHARMACEUTICA",
    "VACCINES": "VACCINES VACCINE VACCINS VACCIN VACC",
    "MEDICAL": "MEDICAL MEDICALE MEDICAUX MED",
    "CONSUMER": "CONSUMER CONSUMERS CONS CONSOMMATION",
    "GENERICS": "GENERICS GENERIC GENERIQUES GENERIQUE GEN",
}
REGION = {
    "CANADA": "CANADA CDA CDN CANADIAN CANADIENNE",
    "INTERNATIONAL": "INTERNATIONAL INTERNATIONALE INTL",
    "GLOBAL": "GLOBAL GLOBALE",
    "ATLANTIC": "ATLANTIC ATLANTIQUE ATL",
    "NORTHAMERICA": "NORTHAMERICA NA",
}
LEGAL = {
    "LTD": "LTD LIMITED LTEE LIMITEE", "INC": "INC INCORPORATED INCORPOREE", "CORP": "CORP CORPORATION", "CO": "CO COMPANY COMPAGNIE CIE", "ULC": "ULC", "LP": "LP", "SEC": "SEC", "LLC": "LLC",
}
#: Given names and the names that stand for them.
GIVEN = {
    "ALEXANDER": "ALEX SANDY", "CATHERINE": "CATHY KATE CATH", "EDWARD": "ED EDDIE NED EDW", "ELIZABETH": "LIZ BETH BETTY ELIZA", "FREDERICK": "FRED FREDDY FREDDIE", "HENRIETTA": "HETTY ETTA",
    "JAMES": "JIM JIMMY JAMIE JAS", "MARGARET": "MEG PEGGY MAGGIE MARG", "RICHARD": "DICK RICK RICH", "ROBERT": "BOB ROB BOBBY ROBT", "THEODORE": "TED TEDDY THEO", "WILLIAM": "WM BILL WILL BILLY",
    "JOHN": "JACK JOHNNY", "CHARLES": "CHARLIE CHUCK CHAS", "THOMAS": "TOM TOMMY THOS", "MICHAEL": "MIKE", "GEORGE": "GEO", "JOSEPH": "JOE", "SAMUEL": "SAM", "DANIEL": "DAN", "ANTHONY": "TONY", "KATHERINE": "KATHY KATIE",
}
DROPPED = frozenset("AND ET OF THE DE DU LA LE PRODUCTS PRODS PROD PRODUITS CARE SOINS".split())
PHRASES = [
    (re.compile(r"\bN(?:ORTH)? AMERICAN?\b"), "NORTHAMERICA"), (re.compile(r"\bHEALTH CARE\b"), "HEALTHCARE"), (re.compile(r"\bINT L\b"), "INTL"), (re.compile(r"\bS E C\b"), "SEC"), (re.compile(r"\bL P\b"), "LP"),
]
LOOKUP = {w: (part, k) for part, lists in (("business", BUSINESS), ("region", REGION), ("legal", LEGAL)) for k, words in lists.items() for w in words.split()}
LOOKUP |= {w: ("given", k) for k, words in GIVEN.items() for w in (k, *words.split())}
PARSED = "name_id long, key string, orders array<string>, given string, business string, region string, legal string, acronym string"


@lru_cache(1)
def known_words() -> Trie:
    t = Trie()
    for w, v in LOOKUP.items():
        if len(w) >= 7:
            t.add(w, v)
    return t


def fold(s: str) -> str:
    s = unicodedata.normalize("NFKD", s.replace("’", "'")).encode("ascii", "ignore").decode().upper().replace("'", " " if "INT'L" not in s.upper() else "")
    s = re.sub(r"\b((?:[A-Z]\.){1,}[A-Z])\b\.?", lambda m: m.group().replace(".", "") + " ", s)
    s = " ".join(re.sub(r"[^A-Z0-9]+", " ", s).split())
    for p, r in PHRASES:
        s = p.sub(r, s)
    return s


def token_orders(core: list[str]) -> Iterable[Sequence[str]]:
    """All orders of up to four words; of more, as written, reversed, and the least with no or one word moved.

    The least order (of all as strings without blanks) is among them, so the same words give the same least key. An error
    at the start of a word moves that word only.
    """
    if len(core) <= 4:
        return permutations(core)
    least = sorted(core, key=cmp_to_key(lambda a, b: (a + b > b + a) - (a + b < b + a)))
    moved = [[*(rest := least[:i] + least[i + 1 :])[:j], w, *rest[j:]] for i, w in enumerate(least) for j in range(len(core))]
    return [core, core[::-1], *moved]


def parse_name(spelling: str) -> dict:
    """Parts of a name; key: its core without blanks, in the order written."""
    out: dict = {"given": "", "business": "", "region": "", "legal": "", "acronym": ""}
    core: list[str] = []
    initial = ""
    folded = fold(spelling)
    for w in folded.split():
        part = LOOKUP.get(w)
        if part is None and len(w) >= 8:
            part = next((v for v, _ in known_words().within(w, 1)), None)
        if part:
            if not out[part[0]]:
                out[part[0]] = part[1]
        elif w in DROPPED:
            continue
        elif len(w) == 1:
            initial = initial or w
        else:
            core.append(w)
    if not core:
        core = [out["given"] or folded.replace(" ", "")]
        out["given"] = ""
    if not out["given"] and initial:
        out["given"] = initial
    if len(core) == 1 and 2 <= len(core[0]) <= 4 and not out["business"] and not out["given"]:
        out["acronym"] = core[0]
    out["key"] = "".join(core)
    out["orders"] = sorted({"".join(p) for p in token_orders(core)})
    # what an acronym of the name would be: given name, core and line of business by their first letters
    out["initials"] = (out["given"][:1] + "".join(w[0] for w in core) + out["business"][:1]) if out["business"] else ""
    return out


def parse_names(names: DataFrame) -> DataFrame:
    """name_id, spelling -> parts. Null and blank spellings name nobody and are left out, as are rows without name_id."""
    schema = PARSED + ", initials string"
    target = arrow_schema(names.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, parse_name(s)) for i, s in zip(b.column("name_id").to_pylist(), b.column("spelling").to_pylist())]
            cols = [pa.array([i for i, _ in rows], pa.int64()), *(pa.array([r[f.name] for _, r in rows], f.type) for f in list(target)[1:])]
            yield pa.RecordBatch.from_arrays(cols, schema=target)

    return names.select(F.col("name_id").cast("long"), "spelling").where("trim(spelling) <> '' AND name_id IS NOT NULL").mapInArrow(run, schema)


INDEX_SHARD, QUERY_SHARD = 5_000, 20_000


def trie_join(keys: DataFrame, buckets: int) -> DataFrame:
    """(a, b, distance) of each key a, any order of its tokens, with each other key b within the allowed distance.

    keys: key, orders; keys unique. A segment that many names hold is split into several tries, and its queries over
    several tasks, so that no shard outgrows INDEX_SHARD names and QUERY_SHARD queries.
    """

    def cut_index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(s, o, k) for k, orders in zip(b.column("key").to_pylist(), b.column("orders").to_pylist()) for o in orders for s in segments(o)]
            yield pa.RecordBatch.from_pydict({n: [r[i] for r in rows] for i, n in enumerate(("seg", "w", "b"))}, schema=pa.schema([(n, pa.string()) for n in ("seg", "w", "b")]))

    def cut_queries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(s, k) for k in b.column("key").to_pylist() for s in substrings(k)]
            for i in range(0, len(rows), 20_000):
                part = rows[i : i + 20_000]
                yield pa.RecordBatch.from_pydict({"seg": [r[0] for r in part], "a": [r[1] for r in part]}, schema=pa.schema([("seg", pa.string()), ("a", pa.string())]))

    index = keys.select("key", "orders").mapInArrow(cut_index, "seg string, w string, b string")
    queries = keys.select("key").mapInArrow(cut_queries, "seg string, a string")
    sizes = index.groupBy("seg").agg(F.ceil(F.count("*") / INDEX_SHARD).cast("int").alias("tries"))
    asked = queries.groupBy("seg").agg(F.ceil(F.count("*") / QUERY_SHARD).cast("int").alias("tasks"))
    shards = sizes.join(asked.hint("merge"), "seg")
    salt = lambda c, n: F.pmod(F.xxhash64(c), n).cast("int")
    i = index.join(shards.hint("merge"), "seg").select("seg", salt("w", F.col("tries")).alias("t"), F.explode(F.sequence(F.lit(0), F.col("tasks") - 1)).alias("k"), "w", "b")
    q = queries.join(shards.hint("merge"), "seg").select("seg", F.explode(F.sequence(F.lit(0), F.col("tries") - 1)).alias("t"), salt("a", F.col("tasks")).alias("k"), "a")
    bucket = F.pmod(F.xxhash64("seg", "t", "k"), F.lit(buckets)).alias("bucket")

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        words, tries = defaultdict(list), {}
        for k, w, b in zip(zip(left["seg"], left["t"], left["k"]), left["w"], left["b"]):
            words[k].append((w, b))
        for k, a in zip(zip(right["seg"], right["t"], right["k"]), right["a"]):
            if (trie := tries.get(k)) is None:
                if k not in words or (len(words[k]) == 1 and words[k][0][1] == a):
                    continue  # nothing but the name itself
                trie = tries[k] = Trie()
                for w, b in words[k]:
                    trie.add(w, (w, b))
            out += [(a, b, d) for (w, b), d in trie.within(a, bound_of(len(a))) if b != a and d <= allowed(a, w)]
        return pd.DataFrame(out, columns=["a", "b", "distance"]).drop_duplicates()

    pairs = i.select(bucket, "seg", "t", "k", "w", "b").groupBy("bucket").cogroup(q.select(bucket, "seg", "t", "k", "a").groupBy("bucket")).applyInPandas(run, "a string, b string, distance int")
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "distance"))
    return both.groupBy("a", "b").agg(F.min("distance").alias("distance"))


def link_names(names: DataFrame, rows: int) -> DataFrame:
    """(name_id, firm): every name with the id of its firm, which is the smallest name_id linked to it.

    names: name_id unique, spelling; rows: about how many. Exact copies of a spelling are linked like any others. Names
    that fit several firms equally well stay alone. An empty table gives no rows.
    """
    parsed = cut(parse_names(names))
    full = parsed.where("acronym = ''")
    # a unit is what is surely one firm: same core in any order, line of business and given name
    canon = F.array_min("orders")
    units = full.groupBy(canon.alias("key"), "business", "given").agg(F.count("*").alias("n"), F.mode("region", True).alias("region"), F.mode("legal", True).alias("legal"), F.min("name_id").alias("unit"))
    keys = full.groupBy(canon.alias("key")).agg(F.count("*").alias("freq"), F.array_distinct(F.flatten(F.collect_set("orders"))).alias("orders"))
    near = cut(trie_join(keys.select("key", "orders"), max(12, -(-rows // 1500))))
    totals = units.groupBy("key", "business").agg(F.sum("n").alias("kn"))
    u = cut(units.join(totals, ["key", "business"]))
    a = u.select(F.col("unit").alias("ua"), F.col("key").alias("a"), F.col("business").alias("ba"), F.col("given").alias("ga"), F.col("region").alias("ra"), F.col("legal").alias("la"), F.col("kn").alias("na"))
    b = u.select(F.col("unit").alias("ub"), F.col("key").alias("b"), F.col("business").alias("bb"), F.col("given").alias("gb"), F.col("region").alias("rb"), F.col("legal").alias("lb"), F.col("kn").alias("nb"))
    same = a.select(F.col("a").alias("x")).distinct().select(F.col("x").alias("a"), F.col("x").alias("b"), F.lit(0).alias("distance"))
    given_fits = (F.col("ga") == F.col("gb")) | (F.col("ga") == "") | (F.col("gb") == "") | ((F.length("ga") == 1) & F.col("gb").startswith(F.col("ga"))) | ((F.length("gb") == 1) & F.col("ga").startswith(F.col("gb")))
    business_fits = (F.col("ba") == F.col("bb")) | (F.col("ba") == "")
    # a goes to b: b says at least as much, and is the more frequent core or, of the same core, the fuller unit
    fuller = (F.length("bb") > 0).cast("int") * 2 + (F.length("gb") > 1).cast("int") - (F.length("ba") > 0).cast("int") * 2 - (F.length("ga") > 1).cast("int")
    # every link goes up in (has a business, frequency, key, fullness, unit), so that none leads back, whatever is linked at 0
    up = ((F.col("ba") == "") & (F.col("bb") != "")) | ((F.col("ba") == F.col("bb")) & ((F.col("nb") > F.col("na")) | ((F.col("nb") == F.col("na")) & (F.col("b") < F.col("a")))))
    told = (F.col("bb") != "") | (F.col("ba") == "")
    goes = (
        F.when(F.col("a") == F.col("b"), (F.col("ua") != F.col("ub")) & ((fuller > 0) | ((fuller == 0) & (F.col("ub") < F.col("ua")))) & told)
        .when(F.col("distance") == 0, up & told)
        .otherwise((F.col("bb") != "") & up & ((F.col("na") <= 2) | (F.col("na") * 3 <= F.col("nb"))))
    )
    agree = (F.col("ra") == F.col("rb")).cast("int") * 2 + ((F.col("la") == F.col("lb")) & (F.col("la") != "")).cast("int")
    # typing leaves the region as it is or out; two errors need the region or the legal form to agree
    clash = (F.col("ra") != "") & (F.col("rb") != "") & (F.col("ra") != F.col("rb"))
    sure = (F.col("distance") == 0) | (~clash & ((F.col("distance") < 2) | (F.length("b") >= 14) | ((F.col("ra") == F.col("rb")) & (F.col("ra") != "")) | ((F.col("la") == F.col("lb")) & (F.col("la") != ""))))
    cand = same.unionByName(near).join(a, "a").join(b, "b").where(business_fits & given_fits & goes & sure)
    # the nearest; then whose given name is the same, that agrees best, and the most frequent
    rank = F.struct((-F.col("distance")).alias("d"), (F.col("ba") == F.col("bb")).cast("int").alias("s"), ((F.col("ga") == F.col("gb")) & (F.col("ga") != "")).cast("int").alias("g"), agree.alias("e"))
    top = Window.partitionBy("ua")
    best = (
        cand.select("ua", "ub", "ba", "bb", "ga", "gb", "nb", rank.alias("rank"))
        .withColumn("top", F.max("rank").over(top))
        .where("rank = top")
        .groupBy("ua")
        # equally good firms of different business or given name: no link
        .agg(F.max_by("ub", F.struct("nb", -F.col("ub"))).alias("ub"), F.count_distinct("bb").alias("kinds"), F.count_distinct(F.when(F.length("gb") > 1, F.col("gb"))).alias("givens"))
        .where("kinds = 1 AND givens <= 1")
        .select("ua", "ub")
    )
    parent = stored(u.select(F.col("unit").alias("ua")).join(best, "ua", "left").select("ua", F.coalesce("ub", "ua").alias("root")))
    while True:  # links lead to fuller or more frequent units only, so the way up has no circle; each round doubles its steps
        up = parent.select(F.col("ua").alias("root"), F.col("root").alias("next"))
        higher = stored(parent.join(up, "root", "left").select("ua", F.coalesce("next", "root").alias("root"), (F.col("next") != F.col("root")).alias("moved")))
        parent = higher.drop("moved")
        if higher.where("moved").isEmpty():
            break
    members = full.select("name_id", canon.alias("key"), "business", "given", "region", "legal", "initials").join(u.select("key", "business", "given", F.col("unit").alias("ua")), ["key", "business", "given"]).join(parent, "ua").select("name_id", "root", "initials", "region", "legal")
    members = cut(members)
    known = members.where("initials <> ''").groupBy("initials", "root").agg(F.mode("region", True).alias("region"), F.mode("legal", True).alias("legal"), F.count("*").alias("n"))
    known = known.withColumn("most", F.max("n").over(Window.partitionBy("root"))).where("n = most")
    short = parsed.where("acronym <> ''").select("name_id", F.col("acronym").alias("initials"), F.col("region").alias("r"), F.col("legal").alias("l"))
    fit = short.join(known, "initials").withColumn("e", F.when(F.col("r") == F.col("region"), 2).when((F.col("r") == "") | (F.col("region") == ""), 1).otherwise(-9) + ((F.col("l") == F.col("legal")) & (F.col("l") != "")).cast("int")).where("e >= 1")
    fit = fit.withColumn("top", F.max("e").over(Window.partitionBy("name_id"))).where("e = top").groupBy("name_id").agg(F.min("root").alias("root"), F.count_distinct("root").alias("k")).where("k = 1").select("name_id", "root")
    alone = short.join(fit, "name_id", "left_anti").select("name_id", F.struct("initials", "r", "l").alias("s"))
    same_short = alone.select("name_id", F.min("name_id").over(Window.partitionBy("s")).alias("root"))
    linked = cut(members.select("name_id", "root").unionByName(fit).unionByName(same_short))
    first = linked.groupBy("root").agg(F.min("name_id").alias("firm"))
    return linked.join(first, "root").select("name_id", "firm")


def firm_pairs(linked: DataFrame) -> DataFrame:
    """All pairs of names of a firm, the smaller id first: the form in which the result is asked for."""
    linked = cut(linked)  # read on both sides
    a, b = linked.select(F.col("name_id").alias("name_id_a"), "firm"), linked.select(F.col("name_id").alias("name_id_b"), "firm")
    return a.join(b, "firm").where("name_id_a < name_id_b").select("name_id_a", "name_id_b")
