"""The commands: each reads containers or text, runs operators, and writes containers or JSON."""

from __future__ import annotations

import json
import logging
import os
from argparse import Namespace
from functools import partial

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import available_from_sequence, classes_of, feature_columns, select_features
from ..functions.special import correlation_p_value
from ..model import DatasetRef
from ..operators import features as ft
from ..operators import intervals as iv
from ..operators import modeling as md
from ..operators import overlap as ov
from ..operators import stats as st
from ..operators import tables as tb
from ..operators.matching import match_background
from ..operators.signal import bin_signal, map_signal, masked_stats
from ..operators.values import sample_per_class
from ..session import cut_lineage
from ..sources import store, text
from ..sources.twobit import read_sequences, twobit_sizes
from . import convert as cv
from .dump import region_rows, sorted_map

log = logging.getLogger(__name__)


def _out(args: Namespace) -> DatasetRef:
    return DatasetRef.parse(args.outputfile, getattr(args, "outputgroup", "") or "")


def _write_regions(df: DataFrame, args: Namespace, group: str, files) -> None:
    out = _out(args)
    store.write_group(iv.check_regions(df), out.path, group, lambda stored: store.region_metadata(stored, group, files), args.filemode)


def _write_json(path: str, document) -> None:
    """Result documents: summaries of a few rows per chromosome."""
    folder = os.path.dirname(path)
    if folder:
        os.makedirs(folder, exist_ok=True)
    with open(path, "w", encoding="utf-8") as handle:
        json.dump(document, handle, indent=1, sort_keys=True, default=str)


# ---------------------------------------------------------------- convert, dump, info


def run_convert(spark: SparkSession, args: Namespace) -> None:
    out = _out(args)
    group = out.group or "default"
    if args.task == "signal":
        runs, sizes = cv.convert_signal(
            spark, args.inputfiles, args.chromsizes, args.selectchroms,
            qnorm=not args.noqnorm, merge_stat=args.mergestat, clip=args.clip, dec_ranks=args.decranks,
        )
        metadata = store.signal_metadata(runs, sizes, group, args.inputfiles)
        store.write_group(runs, out.path, group, metadata, args.filemode)
    elif args.task == "region":
        regions = cv.convert_regions(
            spark, args.inputfiles, args.selectchroms, use_header=args.useheader, name_index=args.nameidx,
            score_index=args.scoreidx, keep_top=args.keeptop, min_size=args.filtersize,
        )
        _write_regions(regions, args, group, args.inputfiles)
    elif args.task == "map":
        blocks, metadata = cv.convert_map(
            spark, args.inputfiles[0], args.targetchrom, args.querychrom, args.selectchroms, args.indexcol,
            args.target, args.query, args.minmap,
        )
        store.write_map(blocks, out.path, metadata)
    elif args.task == "chain":
        blocks, metadata = cv.convert_chain(spark, args.inputfiles[0], args.selectchroms, args.target or "target", args.query or "query")
        store.write_map(blocks, out.path, metadata)
    elif args.task == "tfmotif":
        motifs = cv.convert_motifs(spark, args.inputfiles, args.motifdb, args.dbformat)
        motifs.repartition("chrom").sortWithinPartitions("chrom", "bin").write.mode("overwrite").partitionBy("chrom").parquet(out.path)
    else:
        raise ValueError(f"unknown conversion task: {args.task}")


def _show_or_write(df: DataFrame, path: str, delimiter: str, header: bool) -> None:
    if path in ("stdout", "-"):
        if header:
            print(delimiter.join(df.columns))
        # rows come to the console in order, one partition at a time
        for row in df.toLocalIterator():
            print(delimiter.join("" if v is None else str(v) for v in row))
        return
    codec = "gzip" if path.endswith(".gz") else "bzip2" if path.endswith(".bz2") else "none"
    df.write.mode("overwrite").csv(path, sep=delimiter, header=header, compression=codec)


def run_dump(spark: SparkSession, args: Namespace) -> None:
    ref = DatasetRef.parse(args.inputfile, args.inputgroup)
    delimiter = args.delimiter.strip('"')
    if args.mapreference:
        rows = sorted_map(store.read_blocks(spark, ref.path), args.mapreference, args.fullblocks)
        return _show_or_write(rows, args.outputfile, "\t", False)
    kind = store.dataset_kind(spark, ref.path)
    group = ref.group or store.default_group(spark, ref.path)
    data = store.read_group(spark, ref.path, group)
    if kind == "signal":
        sizes = store.read_metadata(spark, ref.path).select("chrom", F.col("length").alias("size")).distinct()
        rows = bin_signal(data, sizes, args.resolution, args.summstat, args.skipends).orderBy("chrom", "start")
    elif kind in ("regions", "features"):
        rows = region_rows(data, group, args.commentheader)
        if args.rtable:
            return _show_or_write(rows.select(F.col("group_index").alias("_row"), *[F.col(f"`{c}`") for c in rows.columns]).orderBy("_row"), args.outputfile, delimiter, not args.noheader)
    else:
        raise RuntimeError(f"cannot tell the kind of data in {ref.path}")
    if args.rtable:
        chrom = rows.columns[0]
        plain = rows.withColumnRenamed(chrom, "chrom")
        rows = tb.row_number_by_position(plain, "_row").select("_row", *plain.columns).orderBy("_row").withColumnRenamed("chrom", chrom)
    _show_or_write(rows, args.outputfile, delimiter, not args.noheader)


def run_info(spark: SparkSession, args: Namespace) -> None:
    kind = store.dataset_kind(spark, args.inputfile)
    print("=== Structure", kind or "unknown")
    spark.read.option("mergeSchema", "true").parquet(f"{args.inputfile}/data").printSchema()
    print("=== Groups", store.list_groups(spark, args.inputfile))
    metadata = store.read_metadata(spark, args.inputfile)
    if metadata is not None:
        print("=== Metadata")
        for row in metadata.toLocalIterator():  # one partition at a time, however many rows there are
            print("\t".join("" if v is None else str(v) for v in row))


# ---------------------------------------------------------------- features


def _feature_inputs(spark: SparkSession, texts, assembly: str = "") -> dict[str, DataFrame]:
    out = {}
    for t in texts:
        ref = DatasetRef.parse_feature(t, assembly)
        out[ref.label] = store.read_group(spark, ref.path, ref.group)
    return out


def compute_features(spark: SparkSession, samples: DataFrame, args: Namespace) -> DataFrame:
    """All requested feature classes for a table of regions, windows included."""
    samples = samples.drop(*feature_columns(samples.columns))
    assembly, blocks = "", None
    if args.mapfile:
        blocks = store.conserved_blocks(spark, args.mapfile, args.mapreference)
        assembly = store.assembly_of_map(spark, args.mapfile, args.mapreference)
    if getattr(args, "window", 0) > 0:
        samples = ft.sliding_windows(samples, args.window, args.stepsize)
    base = cut_lineage(samples)
    spans = cut_lineage(base.select(*ft.REGION).distinct())
    # each class is computed from the distinct spans and joined once, so no step repeats another
    parts: list[DataFrame] = []
    sequence = available_from_sequence(args.features)
    if sequence:
        with_seq = spans.withColumn("seq", F.lit("")) if sequence == ["len"] else ft.attach_sequence(spans, read_sequences(spark, args.seqfile))
        parts.append(ft.sequence_features(cut_lineage(with_seq), sequence, args.kmers).drop("seq"))
    if "tfm" in args.features:
        motifs = spark.read.parquet(args.tfmotifs)
        width = motifs.agg(F.max("width")).first()[0] or 1  # stored by the conversion; any will do without bins
        labels = sorted(r["motif"] for r in motifs.select("motif").distinct().collect())
        parts.append(ft.motif_features(spans, motifs, width, labels))
    tracks = _feature_inputs(spark, args.sigfile, assembly)
    if "msig" in args.features:
        parts += [masked_stats(spans, runs, blocks, label) for label, runs in tracks.items()]
    if "roi" in args.features:
        parts += [ft.roi_features(spans, rois, label, args.roiquant) for label, rois in _feature_inputs(spark, args.roifile, assembly).items()]
    made = base
    for part in parts:
        made = made.join(part, ft.REGION)
    if "asc" in args.features:
        own = "source" if "source" in base.columns else "name"
        named = base.select(own, *ft.REGION).distinct()
        for t in args.ascregions:
            ref = DatasetRef.parse_feature(t, assembly)
            regions = text.read_associated(spark, ref.path)
            for i, (label, runs) in enumerate(tracks.items()):
                one = ft.associated_features(named, regions, ref.label, runs, label, blocks)
                # distances and counts do not depend on the track: keep them once
                keep = [c for c in one.columns if i == 0 or c.startswith(f"ftasc_{ref.label}_{label}_") or c in named.columns]
                made = made.join(one.select(*[F.col(f"`{c}`") for c in keep]), [own, *ft.REGION])
    return made.drop("seq")


def run_compfeat(spark: SparkSession, args: Namespace) -> None:
    ref, out = DatasetRef.parse(args.inputfile, args.inputgroup), _out(args)
    group = out.group or "features"
    select = args.selectchroms
    if args.task == "classify":
        samples = store.read_group(spark, ref.path, ref.group, select)
        made = compute_features(spark, samples, args)
        files = [args.inputfile, *args.sigfile, *args.roifile]
        meta = lambda rows: store.feature_metadata(rows, group, files, args.window, args.features, args.kmers, args.mapfile or "")
        store.write_group(made, out.path, group, meta, args.filemode)
    elif args.task == "matched":
        if not (args.posingroup and args.negingroup):
            raise ValueError("name the groups of the positive and the negative class")
        positive = store.read_group(spark, ref.path, args.posingroup, select)
        negative = store.read_group(spark, ref.path, args.negingroup, select)
        # both sides carry the index that pairs them
        positive = positive.join(negative.select("chrom", "index"), ["chrom", "index"], "left_semi")
        mode = args.filemode
        for side, y, target in ((positive, 1.0, args.posoutgroup), (negative, 0.0, args.negoutgroup)):
            made = compute_features(spark, side, args).withColumn("y_depvar", F.lit(y))
            meta = partial(store.feature_metadata, group=target, files=[args.inputfile], resolution=None, features=args.features, kmers=args.kmers, mapfile=args.mapfile or "")
            store.write_group(made, out.path, target, meta, mode)
            mode = "a"
    elif args.task == "regress":
        chunks = read_sequences(spark, args.seqfile)
        sizes = store.sizes_from_map(spark, args.mapfile, args.mapreference, select)
        blocks = store.conserved_blocks(spark, args.mapfile, args.mapreference)
        runs = store.read_group(spark, ref.path, ref.group)
        windows = ft.training_positions(sizes, args.numsamples, args.resolution)
        with_seq = ft.attach_sequence(windows, chunks)
        made = ft.sequence_features(with_seq, [c for c in args.features if c in ("prm", "gc", "cpg", "oecpg", "rep", "kmf", "dnm")], args.kmers)
        made = ft.signal_features(made, {"": runs}, blocks)
        depvar = masked_stats(windows, runs, None, "y").select("chrom", "start", "end", F.col("ftmsig_y_abs_mean").alias("y_depvar"))
        made = made.join(depvar, ["chrom", "start", "end"]).drop("seq")
        meta = lambda rows: store.feature_metadata(rows, group, [args.inputfile], args.resolution, args.features, args.kmers, args.mapfile)
        store.write_group(made, out.path, group, meta, args.filemode)
    else:
        raise ValueError(f"unknown feature task: {args.task}")


# ---------------------------------------------------------------- signal commands


def run_mapsig(spark: SparkSession, args: Namespace) -> None:
    """Lift a track to the query assembly; the metadata names all query chromosomes with their size."""
    ref, out = DatasetRef.parse(args.inputfile, args.inputgroup), _out(args)
    group = out.group or "default"
    sizes = store.sizes_from_map(spark, args.mapfile, "query", args.selectchroms)
    named = store.list_chroms(spark, ref.path)
    lifted = map_signal(store.read_group(spark, ref.path, ref.group), store.read_blocks(spark, args.mapfile, chroms=(named, None)))
    lifted = lifted.join(sizes.select("chrom"), "chrom", "left_semi").filter(F.col("value") != 0)
    all_chroms = sizes.select("chrom", F.lit(0.0).alias("value"))
    metadata = store.signal_metadata(all_chroms, sizes, group, [args.inputfile])
    store.write_group(lifted, out.path, group, metadata, args.filemode)


def run_norm(spark: SparkSession, args: Namespace) -> None:
    """Quantile-normalise the chromosomes several signal containers share, one output per input."""
    if len(args.inputfiles) < 2:
        if args.symlink:
            source = args.inputfiles[0].rstrip("/")
            target = _norm_path(source, args)
            if source != target and not os.path.lexists(target):
                os.symlink(os.path.abspath(source), target)
        return
    tracks, names, sizes = [], [], None
    for path in sorted(args.inputfiles, key=os.path.basename):
        if _norm_path(path, args) == path.rstrip("/") and args.filemode == "w":
            raise ValueError(f"{path} would be overwritten by its own normalised form")
        tracks.append(store.read_group(spark, path, store.default_group(spark, path)))
        names.append(path)
        here = store.read_metadata(spark, path).select("chrom", F.col("length").alias("size"))
        sizes = here if sizes is None else sizes.unionByName(here)
    sizes = sizes.groupBy("chrom").agg(F.max("size").alias("size"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    shared = [t.join(sizes.select("chrom"), "chrom", "left_semi") for t in tracks]
    normed = cut_lineage(cv.normalise_tracks(shared, names))
    group = _norm_group(args)
    for path in names:
        runs = normed.filter((F.col("sample") == path) & (F.col("value") != 0)).select("chrom", "start", "end", "value")
        store.write_group(runs, _norm_path(path, args), group, store.signal_metadata(runs, sizes, group, [path]), args.filemode)


def _norm_group(args: Namespace) -> str:
    return args.outputgroup or "default"


def _norm_path(path: str, args: Namespace) -> str:
    folder, name = os.path.split(path.rstrip("/"))
    folder = folder if args.outdir == "as_input" else args.outdir
    return os.path.join(folder, name.replace(args.replace, args.suffix))


def run_corr(spark: SparkSession, args: Namespace) -> None:
    a_ref, b_ref = DatasetRef.parse(args.inputfilea, args.inputgroupa), DatasetRef.parse(args.inputfileb, args.inputgroupb)
    a, b = store.read_group(spark, a_ref.path, a_ref.group), store.read_group(spark, b_ref.path, b_ref.group)
    shared = ov.common_chroms(a, b)
    a, b = a.join(shared, "chrom", "left_semi"), b.join(shared, "chrom", "left_semi")
    rois = text.read_bed(spark, args.roifile) if args.roifile and (args.roilimit or args.task == "roi") else None
    results: dict[str, dict] = {}
    segments = None
    if args.task in ("cons", "roi"):
        named = [r["chrom"] for r in shared.collect()]
        blocks = store.conserved_blocks(spark, args.mapfile, args.mapreference, named)
        segments = cut_lineage(st.segment_means(a, b, blocks, rois, args.skipsize))
        for row in st.segment_summary(segments).collect():
            results[row["chrom"]] = {k: v for k, v in row.asDict().items() if k != "chrom"}
    spans = cut_lineage(st.aligned_tracks(a, b)) if segments is None else None
    sizes = store.read_metadata(spark, a_ref.path).select("chrom", F.col("length").alias("size")).distinct()
    for measure in args.measure:
        if segments is not None:
            found = st.MEASURES[measure](segments, ["chrom"], "a", "b")
        elif args.task == "full":
            found = st.corr_full(spans, sizes, measure)
        elif args.task == "active":
            found = st.corr_active(spans, measure)
        else:
            raise ValueError(f"unknown correlation task: {args.task}")
        for row in found.select("chrom", "stat", correlation_p_value(F.col("stat"), F.col("n")).alias("pv")).collect():
            results.setdefault(row["chrom"], {})[measure] = {"stat": row["stat"], "pv": row["pv"]}
    base = os.path.basename
    _write_json(
        args.outputfile,
        {
            "file_A": base(a_ref.path), "file_B": base(b_ref.path), "group_A": a_ref.group or "default", "group_B": b_ref.group or "default",
            "roi_file": base(args.roifile or ""), "roi_limit": args.roilimit, "map_file": base(args.mapfile) if args.mapfile else "None",
            "map_reference": args.mapreference or "None", "task": args.task, "measure": args.measure, "correlations": sorted(results.items()),
        },
    )


# ---------------------------------------------------------------- tables


def run_merge(spark: SparkSession, args: Namespace) -> None:
    refs = DatasetRef.parse_all(args.inputfiles)
    if len(refs) < 2 and not args.valfile:
        log.warning("nothing to merge")
        return
    tables = [store.read_group(spark, r.path, r.group) for r in refs]
    labels = [r.label for r in refs]
    on = ["chrom", *args.mergeon]
    if args.stack:
        merged = tb.stack_tables(tables, labels, args.indicator)
    else:
        merged = tables[0] if len(tables) == 1 else tb.merge_tables(tables, labels, on)
        for ref in DatasetRef.parse_all(args.valfile, "V"):
            values = store.read_group(spark, ref.path, ref.group)
            keys = args.mergeon if args.wgdataset else on
            merged = tb.extend_table(
                merged, values, keys, args.valcolumn, ref.label if len(args.valfile) > 1 or ":" in "".join(args.valfile) else "",
                whole_genome=args.wgdataset, ignore_missing=args.ignoremissing,
            )
    _write_regions(merged, args, _out(args).group or "default", [args.inputfiles, args.valfile])


def run_eval(spark: SparkSession, args: Namespace) -> None:
    if args.task != "overlap":
        raise ValueError(f"unknown evaluation task: {args.task}")
    if len(args.inputfile) < 2:
        raise ValueError("region overlap needs at least two inputs")
    sets = {r.label: store.read_group(spark, r.path, r.group) for r in DatasetRef.parse_all(sorted(args.inputfile))}
    rois = None
    if args.roifile:
        ref = DatasetRef.parse(args.roifile)
        rois = store.read_group(spark, ref.path, ref.group).select("chrom", "start", "end")
    rows = ov.pairwise_overlap(sets, rois, args.mode).orderBy("chrom", "label_a", "label_b").collect()
    document: dict[str, dict] = {}
    for row in rows:
        d = row.asDict()
        a, b = d.pop("label_a"), d.pop("label_b")
        named = {k.replace("a_", f"{a}_", 1) if k.startswith("a_") else k.replace("b_", f"{b}_", 1) if k.startswith("b_") else k: v for k, v in d.items() if k != "chrom"}
        entry = document.setdefault(d["chrom"], {"chrom": d["chrom"], "roi_info": {"roi_file": args.roifile} if args.roifile else {}, "stats": {}})
        entry["stats"][f"{a}_vs_{b}"] = named
    _write_json(args.outputfile, [document[c] for c in sorted(document)])


def run_match(spark: SparkSession, args: Namespace) -> None:
    ref, out = DatasetRef.parse(args.inputfile, args.inputgroup), _out(args)
    fg_group = ref.group or store.default_group(spark, ref.path)
    bg_group = out.group or "background"
    if fg_group.strip("/") == bg_group.strip("/"):
        raise ValueError("foreground and background group are the same")
    if 5 < len(args.features) + len(args.kmers) <= 10:
        log.warning("many features: similar regions will be rare")
    fg = store.read_group(spark, ref.path, fg_group)
    if "index" not in fg.columns:
        fg = tb.row_number_by_position(fg, "index")
    foreground, background = match_background(
        fg, twobit_sizes(spark, args.twobitgenome) if args.twobitgenome.endswith(".2bit") else _chunk_sizes(spark, args.twobitgenome),
        read_sequences(spark, args.twobitgenome), args.features, args.kmers,
        relax_init=args.relaxinit, relax_step=args.relaxstep, relax_limit=args.relaxlimit, max_rounds=args.rounds, seed=args.seed,
    )
    if background.isEmpty() and not args.allownomatch:
        raise ValueError(f"no matches found for {args.inputfile}")
    matched = background.select("chrom", "index")
    log.warning("%d regions have no match", foreground.join(matched, ["chrom", "index"], "left_anti").count())
    foreground = foreground.join(matched if args.savepairs else matched.select("chrom").distinct(), ["chrom", "index"] if args.savepairs else ["chrom"], "left_semi")
    store.write_group(background, out.path, bg_group, store.region_metadata(background, bg_group, [args.inputfile]), args.filemode)
    store.write_group(foreground, out.path, fg_group, store.region_metadata(foreground, fg_group, [args.inputfile]), "a")


def _chunk_sizes(spark: SparkSession, path: str) -> DataFrame:
    chunks = read_sequences(spark, path)
    return chunks.groupBy("chrom").agg(F.sum(F.length("seq")).cast("bigint").alias("size"))


# ---------------------------------------------------------------- models


def load_training_data(spark: SparkSession, args: Namespace, features: list[str] | None) -> tuple[DataFrame, str | None, list[str], dict]:
    """Feature table with target, weights and subset applied; its feature columns; a description."""
    ref = DatasetRef.parse(args.inputfile, args.inputgroup)
    groups = [g for g in store.list_groups(spark, ref.path, ref.group)]
    data = tb.concat_all([store.read_group(spark, ref.path, g) for g in groups])
    target = None
    kind = "n/a"
    if getattr(args, "task", "train") != "est":
        data, target, kind = tb.add_target(data, args.targetvar or None, args.derivetarget or None)
    if getattr(args, "loadweights", ""):
        data = tb.add_weights(data, tb.weights_from_file(spark, args.loadweights))
    if args.subset:
        if os.path.exists(args.subset):
            if args.metadatafilter:
                names = tb.names_from_metadata(spark, args.subset, args.metadatafilter)
            else:
                names = tb.names_from_file(spark, args.subset)
            data = tb.subset_by_names(data, names)
        else:
            data = tb.subset_by_expression(data, args.subset)
    if getattr(args, "balance", False) and target and kind.split("/")[0] in ("bool", "int"):
        name = tb.sample_name_column(data.columns)
        if name is None:
            raise ValueError("balancing needs sample names")
        data = sample_per_class(data, target, name, args.subsample)
    removed: list[str] = []
    if features is None:
        features, removed = select_features(data.columns, args.usefeatures, args.dropfeatures, args.keepfeatures)
    missing = set(features) - set(data.columns)
    if missing or len(features) < 2:
        raise ValueError(f"features missing or too few: {sorted(missing) or features}")
    # models read their data many times
    data = cut_lineage(data)
    md.check_predictors(data, features)
    info = {
        "dataset_info": {"subset": args.subset, "num_samples": data.count(), "num_features": len(features), "target_var": target, "derive_target": args.derivetarget, "target_type": kind},
        "feature_info": {"order": features, "classes": classes_of(features), "removed_classes": classes_of(removed)},
    }
    return data, target, features, info


def run_train(spark: SparkSession, args: Namespace) -> None:
    with open(args.modelspec, encoding="utf-8") as handle:
        spec = json.load(handle)
    data, target, features, info = load_training_data(spark, args, None)
    if spec.get("preprocess"):
        scaler = md.fit_scaler(data, features)
        data = md.scale(data, scaler)
        info["preprocess_info"] = {"preprocessor_name": "StandardScaler", "attributes": scaler}
    weight = "weight" if args.loadweights else None
    model, trained = md.train(data, spec, features, target, weight=weight, tune=not args.notuning, folds=args.cvfolds, parallelism=args.workers)
    info |= trained
    info["model_info"] |= {"name": spec["model_name"], "type": spec["model_type"]}
    if spec["model_type"] == "classifier":
        info["training_info"]["class_order"] = sorted(r[0] for r in data.select(target).distinct().collect())
    if "store_attributes" in spec:
        info["attribute_info"] = md.model_attributes(model, spec["store_attributes"], features)
    if args.calcweights:
        name = tb.sample_name_column(data.columns)
        weights = md.out_of_fold_weights(data, spec, features, target, name, args.cvfolds)
        weights.write.mode("overwrite").csv(args.modelout + ".weights", sep="\t", header=True)
    info["run_info"] = {"model_spec": os.path.basename(args.modelspec), "model_file": os.path.basename(args.modelout), "train_data": os.path.basename(args.inputfile), "train_group": args.inputgroup}
    model.write().overwrite().save(args.modelout)
    _write_json(args.metadataout or args.modelout.rsplit(".", 1)[0] + ".json", info)


def run_apply(spark: SparkSession, args: Namespace) -> None:
    """Predict with a stored model. Predictions go to ``<output>.predictions``, scores to the JSON report."""
    path = args.modelmetadata or args.modelfile.rsplit(".", 1)[0] + ".json"
    with open(path, encoding="utf-8") as handle:
        model_md = json.load(handle)
    model = PipelineModel.load(args.modelfile)
    trained = model_md["dataset_info"]
    args.derivetarget, args.targetvar = trained["derive_target"], "" if trained["derive_target"] else trained["target_var"]
    data, target, features, info = load_training_data(spark, args, model_md["feature_info"]["order"])
    if "preprocess_info" in model_md:
        data = md.scale(data, model_md["preprocess_info"]["attributes"])
    out = md.predict(model, data)
    columns = [c for c in out.columns if c not in features]
    out.select(*columns).write.mode("overwrite").parquet(args.outputfile + ".predictions")
    out = spark.read.parquet(args.outputfile + ".predictions")
    if args.task == "test":
        scoring = md.choose_scoring(args.scoring, model_md)
        prob = None
        if "class_probs" in out.columns:
            out, prob = out.withColumn("_p1", F.element_at("class_probs", -1)), "_p1"
        testing = {"scoring": scoring, "performance": md.score_table(out, scoring, target, prob=prob)}
        if args.numperm > 0:
            scorers = [scoring, *([args.extrascorer] if args.extrascorer else [])]
            stats = md.permutation_test(out, target, scorers, args.numperm, prob=prob)
            testing["permutation_test"] = {"perm_num": args.numperm, "perm_stats": stats[scoring]}
            if args.extrascorer:
                testing["permutation_test"]["perm_stats"][f"perm_extra_{args.extrascorer}"] = stats[args.extrascorer]
        info["testing_info"] = testing
    if args.reduce:
        name = tb.sample_name_column(out.columns)
        merged = md.merge_positive_windows(out, int(args.reduce[0]), name)
        merged.write.mode("overwrite").parquet(args.outputfile + ".regions")
    info["model_info"] = model_md["model_info"]
    info["run_info"] = {"task": args.task, "model_file": os.path.basename(args.modelfile), "data_file": os.path.basename(args.inputfile), "data_group": args.inputgroup, "predictions": os.path.basename(args.outputfile) + ".predictions"}
    _write_json(args.outputfile, info)


COMMANDS = {
    "convert": run_convert, "dump": run_dump, "info": run_info, "compfeat": run_compfeat, "train": run_train, "mapsig": run_mapsig,
    "apply": run_apply, "corr": run_corr, "match": run_match, "merge": run_merge, "eval": run_eval, "norm": run_norm,
}
