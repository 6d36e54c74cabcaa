"""python -m corpusloom --raw FOLDER --root FOLDER STAGE...: runs stages of a corpus build; exit 1 if a requirement or check fails."""

from __future__ import annotations

import argparse
import dataclasses
import sys

from corpusloom.config import PROFILES, BudgetConfig, BuildConfig, DedupConfig, GateConfig, IngestConfig, pick
from corpusloom.plans.stages import Corpus, resolve, run


def with_options(default, args: argparse.Namespace, given: dict):
    """A configuration whose fields come from the command line, then from a file's values, then from its defaults."""
    names = {f.name for f in dataclasses.fields(default)}
    return dataclasses.replace(default, **{n: pick(getattr(args, n, None), given.get(n), getattr(default, n)) for n in names})


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="corpusloom", description=__doc__)
    parser.add_argument("stages", nargs="+", help="existing, ingest, build, rebuild (budget and split from an earlier build's documents), score, apply, count, tokenizers, verify, audit, plan, report, all or every")
    parser.add_argument("--raw", required=True)
    parser.add_argument("--root", required=True)
    parser.add_argument("--config", help="YAML with gates, budget and ingest values")
    parser.add_argument("--group", choices=sorted(PROFILES), default="latin")
    parser.add_argument("--no-near-dedup", action="store_true")
    parser.add_argument("--no-budget", action="store_true")
    parser.add_argument("--dry-run", action="store_true")
    parser.add_argument("--seed", type=int)
    parser.add_argument("--target", type=int, default=500_000_000)
    parser.add_argument("--strided", action="store_true", help="ingest windows over each source up to its share of characters")
    parser.add_argument("--lines", action="store_true", help="the raw documents are files of JSON lines, read by windows of bytes")
    parser.add_argument("--variant", help="build below variants/NAME from the same raw documents")
    parser.add_argument("--existing", help="folder of JSON lines to take in")
    parser.add_argument("--provenance", choices=("manual", "downloaded"), default="downloaded")
    parser.add_argument("--justification", help="why existing files count as manual")
    parser.add_argument("--labels", help="table of ratings (doc_id, score) to distil")
    parser.add_argument("--least-labels", type=int, default=200)
    parser.add_argument("--min-score", type=float, default=2.5)
    parser.add_argument("--models", nargs="*", default=[], help="SentencePiece model files to measure")
    parser.add_argument("--force-size", type=int)
    parser.add_argument("--force-reason")
    parser.add_argument("--sample-split", choices=("train", "val", "test"), default="test")
    parser.add_argument("--sample", type=int, default=20_000)
    parser.add_argument("--manual-tokens", type=int, help="measured, in place of an estimate, for plan")
    parser.add_argument("--urls", help="list of URLs whose crawl plan is made of")
    for rate in ("delay", "hours", "acceptance", "tokens-per-doc"):
        parser.add_argument(f"--{rate}", type=float)
    parser.add_argument("--other", help="corpus folder of another language, for verify")
    for kind in (GateConfig, BudgetConfig, IngestConfig, DedupConfig):
        for f in dataclasses.fields(kind):
            option = f"--{f.name.replace('_', '-')}"
            if option not in parser._option_string_actions:
                parser.add_argument(option, type=float if f.type == "float" else int)
    args = parser.parse_args(argv)
    given: dict = {}
    if args.config:
        import yaml

        with open(args.config, encoding="utf-8") as f:
            given = yaml.safe_load(f) or {}
    defaults = {"gates": GateConfig(), "budget": BudgetConfig(), "ingest": IngestConfig(), "dedup": DedupConfig()}
    gates, budget, ingest, dedup = (with_options(d, args, given.get(k) or {}) for k, d in defaults.items())
    config = BuildConfig(group=args.group, near_dup=not args.no_near_dedup, gates=gates, dedup=dedup, budget=None if args.no_budget else budget)
    if args.seed is not None:
        config = dataclasses.replace(config, seed=args.seed)
    if args.dry_run:
        print("\n".join(resolve(args.stages)))
        return 0
    from pyspark.sql import SparkSession

    given = {n: getattr(args, n) for n in ("target", "strided", "lines", "variant", "existing", "provenance", "justification", "labels", "least_labels", "min_score", "force_size", "force_reason", "sample_split", "sample", "manual_tokens", "urls", "other")}
    given["crawl"] = {n: v for n in ("delay", "hours", "acceptance", "tokens_per_doc") if (v := getattr(args, n)) is not None}
    corpus = Corpus(SparkSession.builder.getOrCreate(), args.root, args.raw, config, ingest, min_manual_fraction=budget.min_manual_fraction, models=tuple(args.models), **given)
    for name, seconds in run(corpus, args.stages).items():
        print(f"{name}: {seconds:.1f} s")
    return 0 if corpus.passed else 1


if __name__ == "__main__":
    sys.exit(main())
