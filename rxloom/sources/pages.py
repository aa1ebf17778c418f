"""Readers of the pages, archives and workbooks that the sources deliver."""

from __future__ import annotations

import csv
import io
import re
import zipfile
from datetime import date
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rxloom.functions import xlsx
from rxloom.functions.names import patent_numbers
from rxloom.functions.similarity import best_options
from rxloom.functions.text import normalize_din
from rxloom.operators.relational import first_rows
from rxloom.sources.files import METRIC, html_rows

EXTRACT_MEMBERS = ("drug.txt", "ingred.txt", "form.txt", "route.txt", "status.txt", "comp.txt")


def is_fresh(fetched: float | None, now: float, ttl: float) -> bool:
    """A time that isn't older than the time to live."""
    return fetched is not None and now - fetched <= ttl


def unpack_extract(archive: str, folder: str) -> None:
    """The extract's files of an archive; one that is missing raises."""
    with zipfile.ZipFile(archive) as z:
        inside = {n.rsplit("/", 1)[-1].lower(): n for n in z.namelist()}
        if missing := [m for m in EXTRACT_MEMBERS if m not in inside]:
            raise ValueError("not in the archive: " + ", ".join(missing))
        for m in EXTRACT_MEMBERS:
            with z.open(inside[m]) as src, open(f"{folder}/{m}", "wb") as dst:
                while block := src.read(1 << 20):
                    dst.write(block)


def filings(pages: DataFrame, key: str, column: str = "html") -> DataFrame:
    """(key, row_no, medicinal_ingredient, company, therapeutic_area, year_month) of all table rows with four cells at least; `Not available` is null."""
    def run(batches):
        for b in batches:
            out = [(k, i, *c[:4]) for k, h in zip(b[key], b[column]) for i, (_, c) in enumerate(html_rows(h, header=False)) if len(c) >= 4]
            yield pd.DataFrame(out, columns=[key, "row_no", "medicinal_ingredient", "company", "therapeutic_area", "year_month"])

    rows = pages.select(key, column).mapInPandas(run, f"{key} {dict(pages.dtypes)[key]}, row_no int, medicinal_ingredient string, company string, therapeutic_area string, year_month string")
    return rows.withColumn("company", F.when(F.trim("company") != "Not available", F.col("company")))


def search_filings(rows: DataFrame, terms: list[str], field: str = "medicinal_ingredient") -> DataFrame:
    """Filings that hold a term in the ingredient or company, each (ingredient, company, month) once; other fields aren't searched."""
    if field not in ("medicinal_ingredient", "company"):
        raise ValueError(f"unsupported: {field}")
    hit = F.lit(False)
    for t in terms:
        hit = hit | F.contains(F.lower(field), F.lit(t.strip().lower()))
    return first_rows(rows.where(hit), ["medicinal_ingredient", "company", "year_month"], [F.col("row_no")])


class _Page(HTMLParser):
    """Options of selects, links, and the lines of the text."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.options: dict[str, list[str]] = {}
        self.links: list[str] = []
        self.text: list[str] = []
        self.select: str | None = None
        self.option: list[str] | None = None
        self.tables: list[dict] = []
        self.heading: list[str] = []
        self.in_heading = False

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag == "select":
            self.select = a.get("id") or a.get("name") or ""
            self.options.setdefault(self.select, [])
        elif tag == "option" and self.select is not None:
            self.end_option()
            self.option = []
        elif tag == "a" and a.get("href"):
            self.links.append(a["href"])
        elif tag == "table":
            self.tables.append({"id": a.get("id") or "", "after": " ".join(self.heading)})
        elif re.fullmatch("h[1-6]", tag):
            self.in_heading, self.heading = True, []

    def end_option(self):
        if self.option is not None and (t := " ".join(" ".join(self.option).split())):
            self.options[self.select].append(t)
        self.option = None

    def handle_data(self, data):
        if self.option is not None:
            self.option.append(data)
        if self.in_heading:
            self.heading.append(data.strip())
        self.text += [" ".join(x.split()) for x in data.split("\n") if x.strip()]

    def handle_endtag(self, tag):
        if tag == "select":
            self.end_option()
            self.select = None
        elif tag == "option":
            self.end_option()
        elif re.fullmatch("h[1-6]", tag):
            self.in_heading = False


def page(html: str | None) -> _Page:
    p = _Page()
    p.feed(html or "")
    p.close()
    return p


def select_options(html: str | None, name: str) -> list[str]:
    """Texts of the options of a select, by its id or name."""
    return page(html).options.get(name, [])


PATENT_COLUMNS = ("ingredient", "brand", "strength", "dosage", "din", "patent_number", "csp")


def register_patents(html: str | None) -> list[tuple[str, ...]]:
    """Rows of seven cells at least of the first table."""
    return [tuple(c[:7]) for t, c in html_rows(html, header=False) if t == 0 and len(c) >= 7]


def search_patents(query: str, options: list[str], results: DataFrame, option: str = "option") -> DataFrame:
    """Rows of the results pages of the options that fit a query, each (ingredient, brand, din, patent) once.

    results: option, row_no and PATENT_COLUMNS. Options are matched on the driver: a list of a page, ten of which count.
    """
    chosen = best_options(query, options)
    hit = results.where(F.col(option).isin(chosen))
    return first_rows(hit, ["ingredient", "brand", "din", "patent_number"], [F.col(option), F.col("row_no")])


_DAY = re.compile(r"\d{4}-\d{2}-\d{2}")


def patent_detail(html: str | None) -> dict[str, str | None]:
    """filing_date, grant_date and expiry_date of a detail page: label rows, else labels in the text, else an event of expiry."""
    rows = [c for _, c in html_rows(html)]
    labelled = {c[0].strip(" :").lower(): c[1] for c in rows if len(c) == 2}
    text = "\n".join(page(html).text)
    out: dict[str, str | None] = {}
    for name, words in (("filing_date", ("filing date", "(22) filed", "filed")), ("grant_date", ("date granted", "(45) issued", "issued")), ("expiry_date", ("expiry date", "expiration date"))):
        told = next((labelled[w] for w in words if w in labelled), None)
        if told is None and (m := re.search(rf"(?:{'|'.join(map(re.escape, words))})\W*({_DAY.pattern})", text, re.I)):
            told = m[1]
        out[name] = (m[0] if (m := _DAY.search(told or "")) else None)
    if out["expiry_date"] is None:
        events = [(m[0], c) for c in rows if len(c) >= 3 and (m := _DAY.search(c[0])) and "expired" in " ".join(c[1:]).lower()]
        out["expiry_date"] = max((d for d, _ in events), default=None)
    return out


def full_detail(first: dict[str, str | None], second: dict[str, str | None], term_change: date = date(1989, 10, 1)) -> dict[str, str | None]:
    """A detail from two sites, the first one's word before the second's; a lacking expiry is 20 years after the filing."""
    out = {k: first.get(k) or second.get(k) for k in ("filing_date", "grant_date", "expiry_date")}
    if out["expiry_date"] is None and out["filing_date"] and (filed := date.fromisoformat(out["filing_date"])) >= term_change:
        leap = filed.month == 2 and filed.day == 29 and (filed.year + 20) % 4
        out["expiry_date"] = filed.replace(year=filed.year + 20, day=28 if leap else filed.day).isoformat()
    return out


#: Columns of the register of protected drugs, the words of their headers, and their places if the headers say nothing.
REGISTER_COLUMNS = {
    "medicinal_ingredient": ("medicinal ingredient", 0), "submission_number": ("submission", 1), "innovative_drug": ("innovative drug", 2), "manufacturer": ("manufacturer", 3),
    "noc_date": ("notice of compliance", 5), "no_file_date": ("no file date", 6), "pediatric_extension": ("pediatric", 7), "data_protection_ends": ("data protection ends", 8),
}


def register_table(html: str | None) -> list[dict[str, str]]:
    """Rows of the register's table: that with the id a1, else after a heading on active or innovative drugs, else whose header names a
    medicinal ingredient. Columns by their headers, else by place; rows without an ingredient are left out."""
    found, rows = page(html).tables, html_rows(html)
    headers: dict[int, list[str]] = {}
    for t, c in rows:
        headers.setdefault(t, [x.lower() for x in c])
    tests = (lambda t: found[t]["id"] == "a1", lambda t: re.search(r"active", found[t]["after"], re.I), lambda t: re.search(r"innovative|data protection", found[t]["after"], re.I), lambda t: any("medicinal" in h for h in headers.get(t, [])))
    chosen = next((t for test in tests for t in range(len(found)) if test(t)), None)
    if chosen is None:
        return []
    head = headers.get(chosen, [])
    at = {c: next((i for i, h in enumerate(head) if words in h), place) for c, (words, place) in REGISTER_COLUMNS.items()}
    body = [c for t, c in rows if t == chosen][1:]
    out = [{c: (r[i].strip() if i < len(r) else "") for c, i in at.items()} for r in body]
    return [r for r in out if r["medicinal_ingredient"]]


def product_page(html: str | None) -> dict[str, str | None]:
    """(ok, pdf_url, pdf_date, description) of a product's page; ok is None if the page couldn't be read, which isn't the same as no document."""
    if not html or not html.strip():
        return {"ok": None, "pdf_url": None, "pdf_date": None, "description": None}
    p = page(html)
    link = next((u for u in p.links if u.lower().split("?")[0].endswith(".pdf")), None)
    text = "\n".join(p.text)
    day = re.search(rf"(?:date|revised|product monograph)[^\d\n]{{0,40}}({_DAY.pattern})", text, re.I)
    said = re.search(r"^Description\s*:?\s*\n?(.+)$", text, re.I | re.M)
    return {"ok": "yes", "pdf_url": link, "pdf_date": day[1] if day else None, "description": said[1].strip() if said else None}


def patent_archive(spark: SparkSession, archive: str) -> tuple[DataFrame, DataFrame]:
    """(drugs, patents) of the bulk archive's two files with a header, with line_no in the order of the file."""
    with zipfile.ZipFile(archive) as z:
        tables = {}
        for name in ("drugs_e.txt", "patent-service_e.txt"):
            member = next(n for n in z.namelist() if n.endswith(name))
            records = list(csv.DictReader(io.TextIOWrapper(z.open(member), "latin-1")))
            columns = [c.strip().lower() for c in (records[0] if records else {})]
            tables[name] = spark.createDataFrame([(i, *r.values()) for i, r in enumerate(records)], "line_no long" + "".join(f", {c} string" for c in columns))
    return tables["drugs_e.txt"], tables["patent-service_e.txt"]


def patents_by_number(patents: DataFrame) -> DataFrame:
    """Dates of each patent number, those of the last line that has it."""
    rows = patents.withColumn("n", F.explode(patent_numbers(F.col("patent_number"))))
    last = rows.groupBy("n").agg(F.max_by(F.struct("filing_date", "date_granted", "expiration_date"), "line_no").alias("m"))
    return last.select(F.col("n").alias("patent_number"), "m.*")


def patents_of_dins(drugs: DataFrame, patents: DataFrame) -> DataFrame:
    """(din, patent_numbers) in the order of the file, each number once; an all-zero number is nobody's."""
    pairs = drugs.select("drug_id", normalize_din(F.col("din")).alias("din")).where("din <> '00000000'").join(patents.select("drug_id", "line_no", F.posexplode(patent_numbers(F.col("patent_number"))).alias("k", "n")), "drug_id")
    first = pairs.groupBy("din", "n").agg(F.min(F.struct("line_no", "k")).alias("at"))
    return first.groupBy("din").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "n"))), lambda x: x["n"]).alias("patent_numbers"))


def workbook_kind(path: str) -> str:
    """xlsx, xls or csv by the first bytes."""
    with open(path, "rb") as f:
        head = f.read(8)
    return "xlsx" if head[:2] == b"PK" else "xls" if head == bytes.fromhex("d0cf11e0a1b11ae1") else "csv"


def data_sheet(path: str) -> str:
    """The sheet called data, else that with the most metric headers, else the first."""
    found = xlsx.sheets(path)
    if named := next((n for n in found if n.strip().lower() == "data"), None):
        return named
    headers = {n: next(xlsx.rows(path, part), []) for n, part in found.items()}
    return max(found, key=lambda n: sum(bool(METRIC.match((h or "").strip())) for h in headers[n]))


def workbook_table(spark: SparkSession, path: str, sheet: str | None = None, header_within: int = 1, marker: str | None = None) -> DataFrame:
    """A sheet as text columns. The header is the first row, or the first of header_within rows that holds the marker; _row is the place in the sheet, from 1."""
    found = xlsx.sheets(path)
    header: list[str] | None = None
    out: list[tuple] = []
    for i, r in enumerate(xlsx.rows(path, found[sheet or data_sheet(path)]), 1):
        if header is None:
            told = [(c or "").strip() for c in r]
            if marker is None or marker.lower() in [c.lower() for c in told] or i >= header_within:
                header = told
            continue
        out.append((i, *((r[k] if k < len(r) else None) for k in range(len(header)))))
    names = header or []
    return spark.createDataFrame(out, "_row long" + "".join(f", `{c or f'_{k}'}` string" for k, c in enumerate(names)))


def catalogue_records(spark: SparkSession, folder: str) -> DataFrame:
    """One record per drug of six folders of JSON files (product, activeingredient, form, route, status, schedule), each a list or a single object.

    Children are nested by code before the joins; a child that is missing is empty, a product that is missing has no record.
    """
    from rxloom.sources.files import json_records

    schemas = {
        "product": "drug_code int, brand_name string, drug_identification_number string, company_name string, class_name string, number_of_ais int, last_update_date string", "activeingredient": "drug_code int, ingredient_name string, strength string, strength_unit string",
        "form": "drug_code int, pharmaceutical_form_name string", "route": "drug_code int, route_of_administration_name string", "status": "drug_code int, status string", "schedule": "drug_code int, schedule_name string",
    }
    t = {k: json_records(spark, f"{folder}/{k}", s) for k, s in schemas.items()}
    out = first_rows(t["product"].where("drug_code IS NOT NULL"), ["drug_code"], [F.col("brand_name")])
    one = F.struct(F.upper("ingredient_name").alias("k"), "ingredient_name", "strength", "strength_unit")
    ing = t["activeingredient"].groupBy("drug_code").agg(F.array_sort(F.collect_list(one)).alias("i"))
    out = out.join(ing.select("drug_code", F.array_join(F.transform("i", lambda x: x["ingredient_name"]), "; ").alias("ingredient"), F.array_join(F.transform("i", lambda x: F.concat_ws(" ", x["strength"], x["strength_unit"])), "; ").alias("strength")), "drug_code", "left")
    for k, c in (("form", "pharmaceutical_form_name"), ("route", "route_of_administration_name"), ("status", "status"), ("schedule", "schedule_name")):
        out = out.join(t[k].groupBy("drug_code").agg(F.array_join(F.array_sort(F.collect_set(c)), "; ").alias(k)), "drug_code", "left")
    return out
