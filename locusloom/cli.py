"""Command line: ``python -m locusloom.cli <command> ...``; settings may come from an ini file."""

from __future__ import annotations

import argparse
import configparser
import logging
import os
import smtplib
import sys
from email.message import EmailMessage

from . import __version__
from .functions.names import file_stamp

# Fixed value: default chromosome pattern (autosomes).
AUTOSOMES = r'"(chr)?[0-9ABCDEF][0-9A-Z]?(\s|$)"'
FILE_MODES = {"replace": "w", "append": "a", "w": "w", "a": "a"}


def _base(config: str | None) -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="locusloom", description="Interval, signal and sequence analytics on Spark", allow_abbrev=False)
    p.add_argument("--config-file", "-cfg", dest="configfile", default=config, help="ini file with parameter values")
    p.add_argument("--version", "-v", action="version", version=__version__)
    p.add_argument("--verbose", "-vb", action="store_true", help="print status messages")
    p.add_argument("--debug", "-dbg", action="store_true", help="same as --verbose")
    p.add_argument("--outfile-mode", "-ofm", choices=list(FILE_MODES), default="w", dest="filemode", help="replace or append to existing outputs")
    p.add_argument("--notify", "-ntf", default="", dest="notify", help="mail address for a completion notice sent through localhost")
    p.add_argument("--send-log", "-snd", action="store_true", dest="sendlog")
    p.add_argument("--log-format", "-lfm", choices=["long", "short"], default="long", dest="log_format")
    p.add_argument("--profile", "-prf", action="store_true", dest="profiling", help="write a profile of the driver process")
    p.add_argument("--no-dump", "-nod", action="store_true", dest="nodump", help="do not write the configuration of the run")
    p.add_argument("--dump-dir", "-dmp", default=os.getcwd(), dest="dumpdir")
    p.add_argument("--workers", "-wrk", type=int, default=1, dest="workers", help="models fitted at the same time in a grid search")
    p.add_argument("--master", default=None, help="Spark master; spark-submit's unless given")
    return p


def _regions_io(p, multi: bool = False, output: bool = True, group: bool = True):
    if multi:
        p.add_argument("--input", "-i", nargs="+", required=True, dest="inputfiles")
    else:
        p.add_argument("--input", "-i", required=True, dest="inputfile")
        p.add_argument("--input-group", "-ig", default="", dest="inputgroup")
    if output:
        p.add_argument("--output", "-o", required=True, dest="outputfile")
    if group:
        p.add_argument("--output-group", "-og", default="", dest="outputgroup")


def _select(p):
    p.add_argument("--select-chroms", "-slc", default=AUTOSOMES, dest="selectchroms")


def _map(p):
    p.add_argument("--map-file", "-map", default=None, dest="mapfile")
    p.add_argument("--map-reference", "-mapref", "-mref", choices=["target", "query"], default=None, dest="mapreference")


def build_parser(config: str | None = None) -> argparse.ArgumentParser:
    main = _base(config)
    sub = main.add_subparsers(dest="command", required=True)

    sub.add_parser("tests", help="run the test suite")

    p = sub.add_parser("info", help="describe a container")
    p.add_argument("--input", "-i", required=True, dest="inputfile")

    p = sub.add_parser("dump", help="write a container as text")
    _regions_io(p, group=False)
    p.add_argument("--map-reference", "-mapref", choices=["target", "query"], default=None, dest="mapreference")
    p.add_argument("--full-blocks", "-fb", action="store_true", dest="fullblocks")
    p.add_argument("--skip-ends", "-ske", type=int, default=0, dest="skipends")
    p.add_argument("--resolution", "-res", type=int, default=1, dest="resolution")
    p.add_argument("--statistic", "-stat", choices=["mean", "max", "min", "sum", "median", "product"], default="mean", dest="summstat")
    p.add_argument("--delimiter", "-delim", default="\t", dest="delimiter")
    p.add_argument("--comment-header", "-cmh", action="store_true", dest="commentheader")
    p.add_argument("--no-header", "-noh", action="store_true", dest="noheader")
    p.add_argument("--R-table", "-rtab", action="store_true", dest="rtable")

    p = sub.add_parser("convert", help="ingest text files")
    p.add_argument("--task", "-tk", required=True, choices=["signal", "region", "map", "chain", "tfmotif"], dest="task")
    _regions_io(p, multi=True)
    _select(p)
    p.add_argument("--chrom-sizes", "-cs", default="", dest="chromsizes")
    p.add_argument("--no-qnorm", "-nq", action="store_true", dest="noqnorm")
    p.add_argument("--merge-stat", "-ms", choices=["mean", "median", "max", "min"], default="mean", dest="mergestat")
    p.add_argument("--clip", "-cl", type=float, default=99.95, dest="clip")
    p.add_argument("--dec-ranks", "-drk", action="store_true", dest="decranks")
    p.add_argument("--name-idx", "-nix", type=int, default=-1, dest="nameidx")
    p.add_argument("--score-idx", "-six", type=int, default=-1, dest="scoreidx")
    p.add_argument("--use-header", action="store_true", dest="useheader")
    p.add_argument("--keep-top", "-topk", type=float, default=95, dest="keeptop")
    p.add_argument("--filter-size", "-fs", type=int, default=0, dest="filtersize")
    p.add_argument("--target-assembly", "-tassm", default="", dest="target")
    p.add_argument("--target-chrom", "-tchr", default="", dest="targetchrom")
    p.add_argument("--query-assembly", "-qassm", default="", dest="query")
    p.add_argument("--query-chrom", "-qchr", default="", dest="querychrom")
    p.add_argument("--index-col", "-idxc", type=int, default=0, dest="indexcol")
    p.add_argument("--min-map", "-min", action="store_true", dest="minmap")
    p.add_argument("--motif-db", "-mdb", default="", dest="motifdb")
    p.add_argument("--db-format", "-dbf", choices=["meme", "map", "list"], default="list", dest="dbformat")

    p = sub.add_parser("norm", help="quantile normalisation of signal containers")
    _regions_io(p, multi=True, output=False)
    p.add_argument("--output-dir", "-od", default="as_input", dest="outdir")
    p.add_argument("--replace", "-rep", default=".sig", dest="replace")
    p.add_argument("--suffix", "-suf", default=".norm.sig", dest="suffix")
    p.add_argument("--sym-link", "-sym", action="store_true", dest="symlink")

    p = sub.add_parser("compfeat", help="compute features")
    p.add_argument("--task", "-tk", required=True, choices=["regress", "classify", "matched"], dest="task")
    _regions_io(p)
    _select(p)
    _map(p)
    p.add_argument("--features", "-ft", nargs="+", default=[], dest="features")
    p.add_argument("--kmers", "-km", type=int, nargs="+", default=[], dest="kmers")
    p.add_argument("--seq-file", "-sf", default="", dest="seqfile")
    p.add_argument("--tf-motifs", "-tfm", default="", dest="tfmotifs")
    p.add_argument("--signal-file", "-sigf", nargs="+", default=[], dest="sigfile")
    p.add_argument("--asc-regions", "-asc", nargs="+", default=[], dest="ascregions")
    p.add_argument("--roi-file", "-roif", nargs="+", default=[], dest="roifile")
    p.add_argument("--roi-quant", "-roiq", nargs="+", default=["all"], choices=["all", "binary", "counts", "coverage"], dest="roiquant")
    p.add_argument("--num-samples", "-smp", type=int, default=20000, dest="numsamples")
    p.add_argument("--resolution", "-res", type=int, default=25, dest="resolution")
    p.add_argument("--pos-ingroup", "-pig", default="", dest="posingroup")
    p.add_argument("--neg-ingroup", "-nig", default="", dest="negingroup")
    p.add_argument("--add-seq", "-ads", action="store_true", dest="addseq")
    p.add_argument("--pos-outgroup", "-pog", default="pos", dest="posoutgroup")
    p.add_argument("--neg-outgroup", "-nog", default="neg", dest="negoutgroup")
    p.add_argument("--window", "-win", type=int, default=0, dest="window")
    p.add_argument("--stepsize", "-stp", type=int, default=0, dest="stepsize")

    p = sub.add_parser("merge", help="merge, extend or stack region tables")
    _regions_io(p, multi=True)
    p.add_argument("--merge-on", "-mrg", nargs="+", default=["name"], dest="mergeon")
    p.add_argument("--add-values", "-val", nargs="*", default=[], dest="valfile")
    p.add_argument("--from-column", "-col", nargs="*", default=[], dest="valcolumn")
    p.add_argument("--wg-dataset", "-wgd", action="store_true", dest="wgdataset")
    p.add_argument("--ignore-missing", "-igm", action="store_true", dest="ignoremissing")
    p.add_argument("--just-stack", "-jst", action="store_true", dest="stack")
    p.add_argument("--add-indicator", "-ind", action="store_true", dest="indicator")

    p = sub.add_parser("train", help="train a model")
    _regions_io(p, output=False, group=False)
    p.add_argument("--model-spec", "-ms", required=True, dest="modelspec")
    p.add_argument("--no-tuning", "-nt", action="store_true", dest="notuning")
    p.add_argument("--use-features", "-uft", nargs="+", default=[], dest="usefeatures")
    one = p.add_mutually_exclusive_group()
    one.add_argument("--drop-features", "-drop", default="", dest="dropfeatures")
    one.add_argument("--keep-features", "-keep", default="", dest="keepfeatures")
    p.add_argument("--target-var", "-var", default="", dest="targetvar")
    p.add_argument("--derive-target", "-drv", default="", dest="derivetarget")
    p.add_argument("--balance", "-bal", action="store_true", dest="balance")
    p.add_argument("--sub-sample", "-smp", type=int, default=2000, dest="subsample")
    p.add_argument("--cv-folds", "-cv", type=int, default=10, dest="cvfolds")
    p.add_argument("--model-output", "-mo", required=True, dest="modelout")
    p.add_argument("--metadata-output", "-do", default="", dest="metadataout")
    p.add_argument("--calc-weights", "-cwt", action="store_true", dest="calcweights")
    p.add_argument("--load-weights", "-swt", default="", dest="loadweights")
    p.add_argument("--subset", "-sub", default="", dest="subset")
    p.add_argument("--sample-metadata", "-cmd", default=None, dest="metadatafilter", help="SQL condition on name, weight, target, pred of the run in --subset")

    p = sub.add_parser("mapsig", help="lift a signal track to the query assembly")
    _regions_io(p)
    _map(p)
    _select(p)
    p.add_argument("--allocate-chroms", "-ac", type=int, default=2, dest="allocate", help="accepted and ignored: Spark sizes its own tasks")

    p = sub.add_parser("apply", help="apply a model")
    p.add_argument("--task", "-t", required=True, choices=["test", "est"], dest="task")
    _regions_io(p)
    p.add_argument("--model-file", "-mdf", required=True, dest="modelfile")
    p.add_argument("--model-metadata", "-mdd", default="", dest="modelmetadata")
    p.add_argument("--reduce-classes", "-red", nargs="*", default=[], dest="reduce")
    p.add_argument("--subset", "-sub", default="", dest="subset")
    p.add_argument("--sample-metadata", "-cmd", default=None, dest="metadatafilter")
    p.add_argument("--num-perm", "-nump", type=int, default=0, dest="numperm")
    p.add_argument("--perm-extra-scorer", "-exscore", default="", dest="extrascorer")
    p.add_argument("--scoring", "-sc", default="", dest="scoring")

    p = sub.add_parser("corr", help="correlate two signal tracks")
    p.add_argument("--task", "-t", required=True, choices=["cons", "active", "full", "roi"], dest="task")
    p.add_argument("--measure", "-ms", nargs="+", required=True, choices=["pearson", "spearman"], dest="measure")
    p.add_argument("--limit-to-roi", action="store_true", dest="roilimit")
    p.add_argument("--skip-size", "-sks", type=int, default=0, dest="skipsize")
    p.add_argument("--roi-file", "-roi", default="", dest="roifile")
    _map(p)
    p.add_argument("--input-a", "-ia", required=True, dest="inputfilea")
    p.add_argument("--input-group-a", "-iga", default="default", dest="inputgroupa")
    p.add_argument("--input-b", "-ib", required=True, dest="inputfileb")
    p.add_argument("--input-group-b", "-igb", default="default", dest="inputgroupb")
    p.add_argument("--output", "-o", required=True, dest="outputfile")

    p = sub.add_parser("eval", help="overlap statistics of region sets")
    p.add_argument("--task", "-t", choices=["overlap"], default="overlap", dest="task")
    p.add_argument("--input", "-i", nargs="+", required=True, dest="inputfile")
    p.add_argument("--roi-file", "-roi", default="", dest="roifile")
    p.add_argument("--output", "-o", required=True, dest="outputfile")
    p.add_argument("--mode", choices=["contained", "overlap"], default="contained")

    p = sub.add_parser("match", help="background regions with similar sequence features")
    _regions_io(p)
    p.add_argument("--2bit-genome", "-2bg", required=True, dest="twobitgenome")
    p.add_argument("--features", "-ft", nargs="+", default=["len", "gc", "rep"], dest="features")
    p.add_argument("--kmers", "-km", type=int, nargs="+", default=[], dest="kmers")
    p.add_argument("--timeout", "-to", type=int, default=10, dest="timeout", help="accepted and ignored: the search ends when it makes no progress")
    p.add_argument("--rounds", type=int, default=None, help="stop after so many rounds")
    p.add_argument("--seed", type=int, default=0)
    p.add_argument("--allow-nomatch", "-anm", action="store_true", dest="allownomatch")
    p.add_argument("--relax-init", "-ri", type=float, default=1.0, dest="relaxinit")
    p.add_argument("--relax-step", "-rs", type=float, default=0.5, dest="relaxstep")
    p.add_argument("--relax-limit", "-rl", type=float, default=3.0, dest="relaxlimit")
    p.add_argument("--save-pairs", "-sp", action="store_true", dest="savepairs")

    if config:
        ini = configparser.ConfigParser()
        ini.read([config])
        values = {k: v for section in ini.sections() for k, v in ini.items(section)} | dict(ini.defaults())
        main.set_defaults(**values)
        for command in sub.choices.values():
            known = {a.dest for a in command._actions}
            command.set_defaults(**{k: v for k, v in values.items() if k in known})
    return main


def parse(argv: list[str]) -> argparse.Namespace:
    first = argparse.ArgumentParser(add_help=False, allow_abbrev=False)
    first.add_argument("--config-file", "-cfg", dest="configfile")
    known, _ = first.parse_known_args(argv)
    args = build_parser(known.configfile).parse_args(argv)
    args.filemode = FILE_MODES[args.filemode]
    return args


def dump_configuration(args: argparse.Namespace) -> str:
    """Write the environment and all parameters of a run as an ini file."""
    ini = configparser.ConfigParser(allow_no_value=True, interpolation=None)
    ini.optionxform = str
    ini["ENVIRONMENT"] = {k: os.environ.get(k, "N/A") for k in ("USER", "PATH", "PYTHONPATH", "PWD", "SHELL", "HOSTNAME")} | {"VERSION": __version__}
    ini["CONFIGURATION"] = {k: str(v) for k, v in sorted(vars(args).items())}
    os.makedirs(args.dumpdir, exist_ok=True)
    path = os.path.join(args.dumpdir, f"{file_stamp()}_{args.command}.ini")
    with open(path, "w", encoding="utf-8") as handle:
        ini.write(handle)
    return path


def _notify(args: argparse.Namespace, code: int) -> None:
    message = EmailMessage()
    message["Subject"] = f"locusloom {args.command} ended with exit code {code}"
    message["From"] = message["To"] = args.notify
    try:
        with smtplib.SMTP("localhost") as server:
            server.send_message(message)
    except OSError as error:
        logging.getLogger(__name__).warning("no notification sent: %s", error)


def main(argv: list[str] | None = None) -> int:
    args = parse(sys.argv[1:] if argv is None else argv)
    detail = "%(asctime)s %(name)s %(levelname)s: %(message)s" if args.log_format == "long" else "%(levelname)s: %(message)s"
    logging.basicConfig(level=logging.DEBUG if args.verbose or args.debug else logging.WARNING, format=detail)
    logging.getLogger("py4j").setLevel(logging.WARNING)
    if args.command == "tests":
        import pytest

        return int(pytest.main([os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tests"), "-q"]))
    if not args.nodump:
        dump_configuration(args)
    from .plans.commands import COMMANDS
    from .session import build_session

    spark = build_session(f"locusloom {args.command}", args.master)
    code = 0
    try:
        if args.profiling:
            import cProfile

            cProfile.runctx("COMMANDS[args.command](spark, args)", globals(), locals(), f"{file_stamp()}.prof")
        else:
            COMMANDS[args.command](spark, args)
    except Exception:
        code = 1
        logging.getLogger(__name__).exception("%s failed", args.command)
    if args.notify:
        _notify(args, code)
    return code


if __name__ == "__main__":
    sys.exit(main())
