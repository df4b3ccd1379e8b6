"""Whole analyses: named parts over one data folder, as a report. ``python -m folioscope.audit --help`` lists the options."""

from __future__ import annotations

import argparse
import importlib
import pkgutil
import sys
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

import folioscope.plans as plans
from folioscope import sinks

# The parts of each analysis are queries of the plans; each reads its whole tables.
AUDITS: dict[str, tuple[str, ...]] = {
    "corpus": ("corpus_accounting", "locus_type_summary", "label_overlap", "structure_test", "metadata_mi_topic", "topic_histogram", "lgo_ngram_bits", "word_order_gain_lm", "word_entropy", "conditional_entropy_k0_k3", "adjacency_rates", "repeated_ngram_rates", "top_ngrams", "mark_counts_and_legacy_clean"),
    "languages": ("bhattacharyya_rank", "length_only_rank", "conditional_pattern_rank", "three_distances", "matched_bootstrap_winners", "pseudotext_invariance", "first_containing_name"),
    "references": ("multi_granularity_groups", "resample_both", "resample_groups", "range_join_sections", "sequence_summary", "provenance_digest"),
    "herbal": ("sequence_summary", "perm_test_line_position", "heading_forms", "span_bootstrap"),
    "residual": ("residual_identity_bits", "residual_mass_check", "vocabulary_coverage", "weight_summary"),
    "decomposition": ("mixture_weights", "copy_weights", "fold_summary"),
    "bounds": ("prequential_word_windows", "word_order_gain_prequential", "stream_upper_bound", "reference_rank_bound", "cohort_filters"),
    "mechanisms": ("channel_model_bits", "lexicon_hit_rate", "frequency_key", "fold_agreement", "copy_weights"),
    "labels": ("label_extraction", "mapping_constraints", "reading_mappings", "anagram_key_counts", "version_space_votes", "block_permutations"),
}


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [importlib.import_module(f"folioscope.plans.{m.name}") for m in pkgutil.iter_modules(plans.__path__)]
    return {name: f for m in found for name, f in getattr(m, "QUERIES", {}).items()}


def audit(spark: SparkSession, data: str, name: str = "corpus", parts: Sequence[str] | None = None) -> dict[str, DataFrame]:
    """The results of an analysis by part; ``parts`` picks some of them. Unknown names are an error."""
    queries, wanted = all_queries(), list(parts or AUDITS[name])
    missing = [p for p in wanted if p not in queries]
    if missing:
        raise ValueError(f"no such part: {', '.join(missing)}")
    return {p: queries[p](spark, data) for p in wanted}


def named_path(value: str) -> tuple[str, str]:
    """``NAME=PATH`` with both sides given."""
    name, sep, path = value.partition("=")
    if not (sep and name and path):
        raise argparse.ArgumentTypeError(f"{value!r} is not NAME=PATH")
    return name, path


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="folioscope.audit", description="Runs a whole analysis over folders of Parquet tables.")
    p.add_argument("analysis", choices=sorted(AUDITS))
    p.add_argument("--data", required=True, help="folder of the primary tables")
    p.add_argument("--control", action="append", type=named_path, default=[], metavar="NAME=PATH", help="folder of a control, analysed alike; may be repeated")
    p.add_argument("--part", action="append", help="a part of the analysis only; may be repeated")
    p.add_argument("--format", choices=("json", "markdown", "text"), default="json")
    p.add_argument("--output", help="file for the report instead of standard output")
    return p


def main(arguments: Sequence[str] | None = None, spark: SparkSession | None = None) -> str:
    options = parser().parse_args(arguments)
    spark = spark or SparkSession.builder.getOrCreate()
    made: dict[str, list[dict]] = {}
    for label, folder in [("", options.data), *options.control]:
        made |= {f"{label}_{k}" if label else k: rows for k, rows in sinks.report(audit(spark, folder, options.analysis, options.part)).items()}
    out = {"json": sinks.json_text, "markdown": lambda m: sinks.markdown_text(m, f"Analysis: {options.analysis}"), "text": sinks.text_summary}[options.format](made)
    if options.output:
        sinks.write_text(options.output, out)
    else:
        sys.stdout.write(out)
    return out


if __name__ == "__main__":
    main()
