"""Command line: ``python -m logspark [options] [program]``."""

from __future__ import annotations

import argparse
import re
import sys

from . import __version__
from .engine import Engine
from .errors import ProgramError, SourceError
from .lang import parse
from .lang.nodes import dump
from .sinks import FORMATS, write

_LEVELS = {"trace": "TRACE", "debug": "DEBUG", "info": "INFO", "warn": "WARN", "err": "ERROR", "critical": "FATAL", "off": "OFF"}


def _stamp(text: str) -> str:
    if not re.fullmatch(r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}", text):
        raise argparse.ArgumentTypeError(f"{text!r} is no ISO8601 timestamp")
    return text


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("logspark", description="Queries over line-oriented logs, on Spark.")
    p.add_argument("program", nargs="?", help="query file; standard input if left out")
    p.add_argument("-f", "--format", choices=list(FORMATS), default="PrettyTable")
    p.add_argument("-l", "--log-level", choices=list(_LEVELS), default="err")
    p.add_argument("-j", "--threads", type=int, default=1, help="local threads, unless --master is given")
    p.add_argument("-k", "--keep-output-order", action="store_true", help="results always come in query order; accepted for compatibility")
    p.add_argument("--no-buffer", action="store_true", help="write rows as they arrive; one query only")
    p.add_argument("--time-from", type=_stamp)
    p.add_argument("--time-to", type=_stamp)
    p.add_argument("-o", "--option", action="append", default=[], metavar="KEY=VALUE", help="Spark configuration")
    p.add_argument("--explain", action="store_true", help="Spark's plans")
    p.add_argument("--print-ast", action="store_true")
    p.add_argument("--print-bound", action="store_true")
    p.add_argument("--print-ir-unoptimized", action="store_true", help="Spark's analyzed plan")
    p.add_argument("--print-ir-optimized", action="store_true", help="Spark's optimized plan")
    p.add_argument("--print-optimize-report", action="store_true", help="Spark's time by rule")
    p.add_argument("--profile-text", action="store_true", help="the executed plan with its metrics, to standard error")
    p.add_argument("--profile-flamegraph", action="store_true", help="folded stacks of plan nodes by output rows, to prof.N.folded")
    p.add_argument("--profile-dot-graph", action="store_true", help="the executed plans, to prof.dot")
    p.add_argument("--run", action="store_true", help="execute too when a diagnostic is asked for")
    p.add_argument("--print-stacktrace", action="store_true")
    p.add_argument("--master", help="Spark master")
    p.add_argument("--allow-stream", action="store_true", help="let STREAM run commands on the driver")
    p.add_argument("--version", action="version", version=f"logspark {__version__}")
    return p


def _session(args):
    from pyspark.sql import SparkSession

    builder = SparkSession.builder.appName("logspark").config("spark.ui.showConsoleProgress", "false")
    builder = builder.master(args.master or f"local[{args.threads}]")
    for pair in args.option:
        key, _, value = pair.partition("=")
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel(_LEVELS[args.log_level])
    return spark


def _children(node) -> list:
    """Inputs of a physical node, looking through adaptive wrappers and stages to what ran."""
    name = node.nodeName()
    if name == "AdaptiveSparkPlan":
        return [node.executedPlan()]
    if name.endswith("QueryStage"):
        return [node.plan()]
    found = node.children()
    return [found.apply(i) for i in range(found.size())]


def _rows(node) -> int:
    metric = node.metrics().get("numOutputRows")
    return metric.get().value() if metric.isDefined() else 0


def folded(node, above: str = "") -> list[str]:
    path = f"{above};{node.nodeName().strip()}" if above else node.nodeName().strip()
    return [f"{path} {_rows(node)}", *(line for c in _children(node) for line in folded(c, path))]


def dot(roots: list) -> str:
    """A graph of the physical nodes of all plans with their output rows."""
    lines, number = ["digraph plans {"], 0

    def visit(node) -> int:
        nonlocal number
        own = number = number + 1
        lines.append(f'  n{own} [label="{node.nodeName().strip()}\\n{_rows(node)} rows"];')
        for c in _children(node):
            lines.append(f"  n{visit(c)} -> n{own};")
        return own

    for root in roots:
        visit(root)
    return "\n".join([*lines, "}"]) + "\n"


def main(argv: list[str] | None = None, spark=None, out=None) -> int:
    args, out = parser().parse_args(argv), out or sys.stdout
    if args.program:
        with open(args.program, encoding="utf-8") as f:
            text = f.read()
    else:
        text = sys.stdin.read()
    diagnose = args.explain or args.print_ast or args.print_bound or args.print_ir_unoptimized or args.print_ir_optimized or args.print_optimize_report
    try:
        if args.print_ast:
            out.write(dump(parse(text)))
        engine = Engine(spark or _session(args), None, args.time_from, args.time_to, args.allow_stream)
        if args.print_bound:
            for name, rel in engine.bind(text):
                out.write((f"{name} =\n" if name else "") + rel.dump() + "\n")
        results = engine.results(text)
        if args.no_buffer and len(results) > 1:
            sys.stderr.write("--no-buffer needs a single query\n")
            return 2
        for result in results:
            if args.explain or args.print_ir_unoptimized or args.print_ir_optimized or args.print_optimize_report:
                plan = result.frame._jdf.queryExecution()
                if args.print_ir_unoptimized:
                    out.write(plan.analyzed().toString() + "\n")
                if args.print_ir_optimized:
                    out.write(plan.optimizedPlan().toString() + "\n")
                if args.print_optimize_report:
                    plan.optimizedPlan()
                    out.write(plan.tracker().rules().mkString("\n") + "\n")
                if args.explain:
                    out.write(plan.toString() + "\n")
        if not diagnose or args.run:
            ran = []
            for number, result in enumerate(results, 1):
                frame = result.frame
                write(result, args.format, out, frame)
                ran.append(plan := frame._jdf.queryExecution().executedPlan())
                if args.profile_text:
                    sys.stderr.write(plan.toString() + "\n")
                if args.profile_flamegraph:
                    with open(f"prof.{number}.folded", "w", encoding="utf-8") as f:
                        f.write("\n".join(folded(plan)) + "\n")
            if args.profile_dot_graph:
                with open("prof.dot", "w", encoding="utf-8") as f:
                    f.write(dot(ran))
        return 0
    except ProgramError as e:
        if args.print_stacktrace:
            raise
        sys.stderr.write(e.shown(text) + "\n")
        return 1
    except SourceError as e:
        sys.stderr.write(f"{e}\n")
        return 1
