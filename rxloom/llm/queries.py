"""Queries of the operators on text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rxloom.llm.entities import match
from rxloom.llm.mixing import mix_choice, share_report, with_shares
from rxloom.llm.names import firm_pairs, link_names
from rxloom.llm.packing import pack_documents, packing_report
from rxloom.llm.quality import document_statistics
from rxloom.llm.scans import repair
from rxloom.llm.tokens import with_token_counts
from rxloom.session import cut
from rxloom.sources.tables import table


def p10_statistics(spark: SparkSession, d: str) -> DataFrame:
    return document_statistics(table(spark, d, "documents"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return p10_statistics(spark, d).where("kind <> 'prose'").select("doc_id", "kind")


def sized_documents(spark: SparkSession, d: str) -> DataFrame:
    """Token counts, computed once and kept in the shared folder."""
    return cut(with_token_counts(table(spark, d, "documents").select("doc_id", "source", "lang", "text")))


def packs(spark: SparkSession, d: str) -> list[tuple[str, int]]:
    return [(r[0], int(r[1])) for r in table(spark, d, "pack_sizes").select("pack_name", "capacity_tokens").collect()]


def p8_packing(spark: SparkSession, d: str) -> DataFrame:
    """Each document once, in the tiers of all capacities."""
    return pack_documents(sized_documents(spark, d), packs(spark, d))


def p8_each(spark: SparkSession, d: str) -> DataFrame:
    """All documents in containers of each capacity alone."""
    return pack_documents(sized_documents(spark, d), packs(spark, d), mixed=False)


def p8_unused(spark: SparkSession, d: str) -> DataFrame:
    return packing_report(p8_packing(spark, d))


def p8_each_unused(spark: SparkSession, d: str) -> DataFrame:
    return packing_report(p8_each(spark, d))


#: The tree of this project's sources.
DOMAINS = {
    "monograph": "label", "leaflet": "label", "scan_dump": "label",
    "approval_summary": "register", "patent_abstract": "register", "recall_notice": "register",
    "market_note": "market", "trade_bulletin": "market",
}


def p9_choice(spark: SparkSession, d: str) -> DataFrame:
    """The largest mixes in which every source that has documents reaches its share."""
    targets = table(spark, d, "mix_targets")
    return with_shares(mix_choice(sized_documents(spark, d), targets, total="reachable", domains=DOMAINS), targets)


def p9_once(spark: SparkSession, d: str) -> DataFrame:
    """Mixes as large as what their sources hold once: where one falls short of its share, its siblings take over."""
    targets = table(spark, d, "mix_targets")
    return with_shares(mix_choice(sized_documents(spark, d), targets, domains=DOMAINS), targets)


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    targets = table(spark, d, "mix_targets")
    return share_report(mix_choice(sized_documents(spark, d), targets, total="reachable", domains=DOMAINS), targets)


def linked_names(spark: SparkSession, d: str) -> DataFrame:
    names = table(spark, d, "company_names")
    return link_names(names, names.count())


def p5_firms(spark: SparkSession, d: str) -> DataFrame:
    """Every name with the id of its firm."""
    return linked_names(spark, d)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return firm_pairs(linked_names(spark, d))


def p7_matches(spark: SparkSession, d: str) -> DataFrame:
    """The drug of each line with its confidence."""
    names = table(spark, d, "company_names")
    return match(table(spark, d, "old_extract"), table(spark, d, "drugproduct"), table(spark, d, "activeingredient"), names, names.count())


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return p7_matches(spark, d).select("drug_code", "line_key")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return repair(table(spark, d, "piqray_pages"))


def p1_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    """The repaired paragraphs of each monograph."""
    return repair(table(spark, d, "piqray_pages"), paragraphs=True)


QUERIES = {f.__name__: f for f in (p1_found, p1_paragraphs, p5_found, p5_firms, p7_found, p7_matches, p10_found, p10_statistics, p8_packing, p8_each, p8_unused, p8_each_unused, p9_choice, p9_once, p9_shares)}
SQL: dict[str, str] = {}
