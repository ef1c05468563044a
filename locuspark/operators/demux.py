"""Demultiplexing: decide each read's destination, repair, clip and label it.

One chain of expressions a read, no shuffle; the report is one aggregation.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locuspark.functions import sequence as S
from locuspark.sources import fastq


@dataclass(frozen=True)
class Demux:
    """Settings.  Empty lists and zeros turn a step off."""

    sites: tuple[str, ...] = ()
    barcodes: tuple[str, ...] = ()
    trunc_first: int = 0
    window: int = 0
    window_score: int = 0
    offset: int = 33
    check_site: bool = True
    repair_site: bool = False
    repair_site_after_barcode: bool = False
    repair_barcode: bool = False
    repair_both: bool = False
    site_most: int = 1
    barcode_most: int = 1
    clip_barcode: bool = True
    even_barcodes: bool = False
    internal_sites: tuple[str, ...] = ()
    adapters: tuple[str, ...] = ()
    #: For reverse mates: the adapters that go with the barcode of the forward mate.
    barcode_adapters: tuple[tuple[str, tuple[str, ...]], ...] = ()
    adapter_rate: float = 0.1
    adapter_overhang: int = 0
    least_insert: int = 1
    crop_adapter: bool = True
    clip_site: bool = False
    mark_adapter: bool = False
    double_adapter: bool = False
    trunc_last: int = 0
    join_mates: bool = False


#: Columns that the tree adds.
RESULT = ["seq", "qual", "good", "dest", "ana", "override"]


def _state(seq: Column, qual: Column, good: Column, dest: Column, ana: Column, override: Column, done: Column) -> Column:
    return F.struct(seq.alias("seq"), qual.alias("qual"), good.cast("int").alias("good"), dest.alias("dest"), ana.alias("ana"), override.alias("override"), done.alias("done"))


def tree(reads: DataFrame, s: Demux, seq: str = "seq", qual: str = "qual", barcode: Column | None = None) -> DataFrame:
    """``reads`` with ``_t``: struct of the result of the decision tree.

    ``barcode`` is that of the mate, for adapters by barcode; without a known
    one there is nothing to look for.
    """
    sites, no = list(s.sites), F.lit("")
    q, u = F.col(seq), F.col(qual)
    if s.trunc_first > 0:
        q, u = S.trunc_to(q, s.trunc_first), S.trunc_to(u, s.trunc_first)
    done = ~S.sliding_quality(u, s.window, s.window_score, s.offset) if s.window else F.lit(False)
    df = reads.withColumn("_t", _state(q, u, ~done, F.when(done, "NN").otherwise("SAMP"), F.when(done, "q_fail").otherwise("clean"), no, done))

    def step(df: DataFrame, new: Column) -> DataFrame:
        return df.withColumn("_t", F.when(F.col("_t.done"), F.col("_t")).otherwise(new))

    def now(**change: Column) -> Column:
        t = {c: F.col(f"_t.{c}") for c in (*RESULT, "done")} | change
        return _state(*[t[c] for c in (*RESULT, "done")])

    def failed(ana: Column | str, override: str = "") -> Column:
        return now(good=F.lit(0), dest=F.lit("NN"), ana=F.lit(ana) if isinstance(ana, str) else ana, override=F.lit(override), done=F.lit(True))

    q, u, ana = F.col("_t.seq"), F.col("_t.qual"), F.col("_t.ana")
    if not s.barcodes:
        if s.check_site:
            if s.repair_site:
                fixed = S.site_repair(q, sites, s.site_most)
                other = F.when(fixed.isNotNull(), now(seq=fixed, ana=F.lit("r1_rep"))).otherwise(failed("r1_rep_fail"))
            else:
                other = failed("r1_c_fail")
            df = step(df, F.when(S.site_starts(q, sites), now()).otherwise(other))
    else:
        bars = list(s.barcodes)
        df = df.withColumn("_e", S.barcode_match(q, bars, sites))
        df = step(df, F.when(F.col("_e").isNotNull(), now(dest=F.col("_e"))).otherwise(now(dest=F.lit("NN"), ana=F.lit("bcr_c_fail")))).drop("_e")
        for on, label, b_most, s_most in ((s.repair_site_after_barcode, "_bc_rrep", 0, s.site_most), (s.repair_barcode, "_bcrep_r", s.barcode_most, 0), (s.repair_both, "_bcrep_rrep", s.barcode_most, s.site_most)):
            if on:
                df = df.withColumn("_r", F.when((F.col("_t.dest") == "NN") & ~F.col("_t.done"), S.barcode_repair(q, bars, sites, b_most, s_most)))
                fixed = now(seq=F.col("_r.seq"), dest=F.col("_r.barcode"), ana=F.concat(ana, F.lit(label)))
                df = step(df, F.when(F.col("_t.dest") != "NN", F.col("_t")).when(F.col("_r").isNotNull(), fixed).otherwise(now(ana=F.concat(ana, F.lit(label + "_fail"))))).drop("_r")
        df = step(df, F.when(F.col("_t.dest") == "NN", failed(ana)).otherwise(F.col("_t")))
        n = F.length("_t.dest")
        if s.clip_barcode:
            df = step(df, now(seq=F.substr(q, n + 1), qual=F.substr(u, n + 1)))
        if s.even_barcodes:
            keep = F.length(q) + n - max(map(len, bars))
            df = step(df, now(seq=S.trunc_to(q, keep), qual=S.trunc_to(u, keep)))
    if s.internal_sites:
        df = step(df, F.when(S.internal_site(q, list(s.internal_sites)), failed(F.concat(ana, F.lit("_rint")), "rint")).otherwise(F.col("_t")))
    length = max(map(len, sites), default=0)

    def clipped(extra: dict[str, Column], fail: Column) -> Column:
        cut = S.site_length(q, sites)
        return F.when(cut.isNotNull(), now(seq=F.substr(q, cut + 1), qual=F.substr(u, cut + 1), **extra)).otherwise(fail)

    if s.adapters or (s.barcode_adapters and barcode is not None):
        if s.adapters:
            start = S.find_adapter(q, list(s.adapters), s.adapter_rate)
        else:
            start = F.coalesce(*[F.when(barcode == b, S.find_adapter(q, list(a), s.adapter_rate)) for b, a in s.barcode_adapters], F.lit(-1))
        df = df.withColumn("_a", F.when(~F.col("_t.done"), start))
        label = F.concat(ana, F.lit("_ad"))
        if s.crop_adapter:
            insert = F.col("_a") + s.adapter_overhang - length
            df = step(df, F.when(F.col("_a") < 0, F.col("_t")).when(insert < s.least_insert, failed(F.concat(label, F.lit("s")), "ads")).otherwise(now(seq=S.trunc_to(q, insert + length), qual=S.trunc_to(u, insert + length), ana=label, override=F.lit("ad"))))
            with_ad = (F.col("_t.override") == "ad") & ~F.col("_t.done")
            df = step(df, F.when(with_ad, clipped({"done": F.lit(True)}, now(good=F.lit(0), done=F.lit(True)))).otherwise(F.col("_t")))
        else:
            df = step(df, F.when(F.col("_a") < 0, F.col("_t")).otherwise(now(ana=label, override=F.lit("ad"))))
        df = df.drop("_a")
    if s.clip_site:
        df = step(df, clipped({}, failed(F.concat(ana, F.lit("_cl_r_fail_seq_in_NN")))))
    return df.withColumn("_t", F.struct(*[F.col(f"_t.{c}").alias(c) for c in RESULT]))


def single(reads: DataFrame, s: Demux) -> DataFrame:
    """``reads`` with new seq and qual, and dest, ana and good."""
    t = tree(reads, s)
    ad = F.col("_t.override") == "ad"
    dest = F.when(ad & F.lit(s.mark_adapter) & (F.col("_t.dest") != "NN"), F.concat(F.col("_t.dest"), F.lit("_ad"))).otherwise(F.col("_t.dest"))
    cut = F.lit(s.trunc_last > 0) & ~ad & (F.col("_t.dest") != "NN")
    text = {c: F.when(cut, S.trunc_to(F.col(f"_t.{c}"), max(s.trunc_last, 0))).otherwise(F.col(f"_t.{c}")) for c in ("seq", "qual")}
    rest = [c for c in reads.columns if c not in ("seq", "qual")]
    return t.select(*rest, text["seq"].alias("seq"), text["qual"].alias("qual"), dest.alias("dest"), F.col("_t.ana").alias("ana"), F.col("_t.good").alias("good"))


def pair_table(f: dict[str, Column], r: dict[str, Column], double: bool, mark: bool) -> Column:
    """Struct (f_dest, r_dest, r_label, copy) from the results (good, dest, override) of both mates.

    ``copy`` says which mate is to be replaced by the reverse complement of the
    other: ``f``, ``r`` or none.  ``r_label`` is the label of a reverse mate that
    is not analysed.
    """
    nn, none = F.lit("NN"), F.lit("")
    ad = F.lit("_ad" if mark else "")
    f_good, r_good = (f["good"] == 1) & (f["dest"] != "NN"), (r["good"] == 1) & (r["dest"] != "NN")
    f_ad, r_ad = f["override"] == "ad", r["override"] == "ad"

    def row(fd: Column, rd: Column, label: Column = none, copy: str = "") -> Column:
        return F.struct(fd.alias("f_dest"), rd.alias("r_dest"), label.alias("r_label"), F.lit(copy).alias("copy"))

    to_f, samp = F.concat(f["dest"], ad), F.concat(F.lit("SAMP"), ad)
    sg = F.lit("_sg")
    out = F.when(f["override"] == "rint", row(nn, nn, F.lit("rint_pair"))).when(f["override"] == "ads", row(nn, nn, F.lit("ads_pair")))
    if double:
        out = out.when(f_good & f_ad, row(to_f, to_f, F.lit("ad_pair"), "r"))
    out = out.when(r["override"].isin("rint", "ads"), row(nn, nn)).when(~f_good & ~r_good, row(nn, nn))
    out = out.when(f_good & f_ad & ~r_good, row(F.concat(f["dest"], F.lit("_ad_sg" if mark else "_sg")), nn)).when(f_good & ~r_good, row(F.concat(f["dest"], sg), nn))
    if double:
        out = out.when(~f_good & r_ad, row(samp, samp, none, "f")).when(f_good & r_ad, row(to_f, to_f, none, "f"))
    else:
        out = out.when(~f_good & r_ad, row(nn, F.lit("SAMP_ad_sg" if mark else "SAMP_sg"))).when(f_good & r_ad, row(to_f, to_f))
    return out.when(~f_good, row(nn, F.lit("SAMP_sg"))).when(f_ad, row(to_f, to_f)).otherwise(row(f["dest"], f["dest"]))


def paired(pairs: DataFrame, forward: Demux, reverse: Demux) -> DataFrame:
    """Pairs (f_seq, f_qual, r_seq, r_qual) with new mates, destinations and labels."""
    t = tree(pairs, forward, "f_seq", "f_qual").withColumnRenamed("_t", "_f")
    t = tree(t, reverse, "r_seq", "r_qual", F.col("_f.dest")).withColumnRenamed("_t", "_v")
    f, r = ({c: F.col(f"{x}.{c}") for c in RESULT} for x in ("_f", "_v"))
    t = t.withColumn("_p", pair_table(f, r, forward.double_adapter, forward.mark_adapter))
    f_seq, r_seq = F.when(F.col("_p.copy") == "f", S.revcomp(r["seq"])).otherwise(f["seq"]), F.when(F.col("_p.copy") == "r", S.revcomp(f["seq"])).otherwise(r["seq"])
    f_qual, r_qual = F.when(F.col("_p.copy") == "f", F.reverse(r["qual"])).otherwise(f["qual"]), F.when(F.col("_p.copy") == "r", F.reverse(f["qual"])).otherwise(r["qual"])
    rest = [c for c in pairs.columns if c not in ("f_seq", "f_qual", "r_seq", "r_qual")]
    no_ad = (f["override"] != "ad") & ((r["override"] != "ad") | (F.col("_p.r_label") != ""))
    t = t.select(*rest, f_seq.alias("f_seq"), f_qual.alias("f_qual"), r_seq.alias("r_seq"), r_qual.alias("r_qual"), F.col("_p.f_dest").alias("f_dest"), F.col("_p.r_dest").alias("r_dest"), f["ana"].alias("f_ana"), F.when(F.col("_p.r_label") != "", F.col("_p.r_label")).otherwise(r["ana"]).alias("r_ana"), no_ad.alias("_plain"))
    for side, s in (("f", forward), ("r", reverse)):
        if s.trunc_last > 0:
            cut = F.col("_plain") & (F.col(f"{side}_dest") != "NN")
            t = t.withColumns({f"{side}_{c}": F.when(cut, S.trunc_to(F.col(f"{side}_{c}"), s.trunc_last)).otherwise(F.col(f"{side}_{c}")) for c in ("seq", "qual")})
    if forward.join_mates:
        both = F.col("_plain") & (F.col("f_dest") != "NN") & (F.col("r_dest") != "NN")
        n = F.least(F.length("f_qual"), F.length("r_qual"))
        fq = F.concat(F.substr("f_qual", F.lit(1), n), F.reverse(F.substr(F.col("r_qual"), F.lit(1), n)))
        a, b = S.concat_revcomp(F.col("f_seq"), F.col("r_seq"))
        new = {"f_seq": a, "r_seq": b, "f_qual": fq, "r_qual": F.reverse(fq)}
        t = t.withColumns({k: F.when(both, v).otherwise(F.col(k)) for k, v in new.items()})
    return t.drop("_plain")


def write_fastq(result: DataFrame, path: str, compress: bool = False, header: str = "header", failed: bool = False) -> None:
    """Reads of ``single`` as FASTQ files in a folder ``dest=...`` each; those without destination only if asked for.

    ``result`` is best a written table: the filter on the destination would
    otherwise work out the chain of repairs once more for every column.
    """
    fastq.write(result if failed else result.filter("dest != 'NN'"), path, ["dest"], compress, header)


def write_fastq_pairs(result: DataFrame, path: str, compress: bool = False, f_header: str = "f_header", r_header: str = "r_header") -> None:
    """Pairs of ``paired`` as FASTQ files, forward and reverse mates in folders of their own."""
    for side, header in (("f", f_header), ("r", r_header)):
        mates = result.filter(F.col(f"{side}_dest") != "NN").withColumn("dest", F.col(f"{side}_dest"))
        fastq.write(mates, f"{path}/{side}", ["dest"], compress, header, f"{side}_seq", f"{side}_qual")


def report(result: DataFrame) -> DataFrame:
    """(dest, ana, n)."""
    return result.groupBy("dest", "ana").agg(F.count(F.lit(1)).alias("n"))
