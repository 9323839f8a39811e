"""End-to-end jobs."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.fixed import REPORT_MONTHS_BACK
from ..functions.times import Now, report_months
from ..operators import aggregates, corpus, dictionary, probes, tlds
from ..sources import companies, lists, registrar_reports


class Corpus(NamedTuple):
    companies: DataFrame
    ranks: DataFrame


def build_corpus(
    tickers: DataFrame,
    overrides: DataFrame,
    index_tickers: DataFrame,
    ranks: DataFrame,
    stored: DataFrame | None = None,
    normalize_class: bool = False,
) -> Corpus:
    """Public companies with index flags, and ranked sites that are none of them.

    ``stored`` is the company table so far: a ranked site already in it is left as it is.
    """
    public = corpus.index_membership(corpus.company_rows(tickers, overrides), index_tickers, normalize_class)
    public = public.select(*corpus.COMPANY_COLUMNS)
    known = public.select("canonical_domain")
    if stored is not None:
        known = known.unionByName(stored.select("canonical_domain"))
    sites = corpus.site_only_rows(ranks, known)
    return Corpus(public.unionByName(sites.select(*corpus.COMPANY_COLUMNS)), ranks)


def corpus_from_files(
    spark: SparkSession, tickers: str, overrides: str, index_page: str, ranks: str, snap_month: str, rank_limit: int | None = None
) -> Corpus:
    doc = companies.read_document
    return build_corpus(
        companies.ticker_rows(doc(spark, tickers)),
        companies.domain_overrides(doc(spark, overrides)),
        companies.index_tickers(doc(spark, index_page)),
        companies.read_site_ranks(spark, ranks, snap_month, rank_limit),
    )


def ingest_registrar_reports(
    spark: SparkSession,
    path: str,
    now: Now = None,
    months_back: int = REPORT_MONTHS_BACK,
    month: str | None = None,
    month_pattern: str = registrar_reports.MONTH_IN_NAME,
) -> DataFrame:
    """Report rows of one month, or of the months due at ``now`` (R7). Other files are not read."""
    wanted = [month] if month else report_months(now, months_back)
    return registrar_reports.read_registrar_reports(spark, path, wanted, month_pattern)


def build_tld_dimension(tld_lines: DataFrame, zone_lines: DataFrame) -> DataFrame:
    """TLD dimension rows from the two public lists."""
    return tlds.tld_rows(lists.tld_list(tld_lines), lists.zone_available(zone_lines))


class Dictionary(NamedTuple):
    words: DataFrame
    union: DataFrame
    index: DataFrame


def build_dictionary(lines: DataFrame) -> Dictionary:
    """Word lists, their union and the part of speech of each word, from (pos, word) lines."""
    words = dictionary.clean_words(lines)
    return Dictionary(words, dictionary.word_union(words), dictionary.pos_index(words))


class ProbeStats(NamedTuple):
    totals: DataFrame
    lengths: DataFrame
    tld_lengths: DataFrame
    tlds: DataFrame
    words: DataFrame


def probe_statistics(
    dns_answers: DataFrame, http_responses: DataFrame, pos_index: DataFrame, mode: str, keys: list[str] | None = None
) -> ProbeStats:
    """Captured answers of one mode -> published aggregates."""
    resolved = probes.resolve(probes.dns_verdicts(dns_answers), keys)
    names = probes.probe_results(resolved, probes.http_usage(http_responses), keys)
    names = names.withColumn("mode", F.lit(mode))
    cells = aggregates.probe_cells(names)
    return ProbeStats(
        aggregates.global_totals(cells),
        aggregates.length_stats(cells),
        aggregates.length_stats_by_tld(cells),
        aggregates.tld_stats(cells),
        aggregates.word_pos_stats(names, pos_index),
    )
