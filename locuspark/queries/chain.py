"""From reads to an export, over the alleles that are called: no step starts from known loci."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locuspark.operators import export, population
from locuspark.operators import individual as I
from locuspark.operators.selection import Selection
from locuspark.queries import catalog_tables as C
from locuspark.queries import loci as L
from locuspark.queries.fixtures import Fixture


def called(f: Fixture) -> DataFrame:
    """Alleles (ind, loc, all_id, seq, depth) called from the reads; written once for each set of tables."""
    return f.stage("called", lambda: I.alleles(I.groups_of(I.snp_call_freq(L.used(f))))[1])


def called_links(f: Fixture) -> tuple[DataFrame, DataFrame]:
    """The catalogue's alleles and the links of individuals to them."""
    alleles = called(f)
    popall = f.stage("called_popall", lambda: population.with_popallvar(population.pop_loci(population.pool_alleles(alleles), C.D)))
    return popall, f.stage("called_links", lambda: population.link_alleles(alleles, popall))


def reads_to_catalogue(f: Fixture) -> DataFrame:
    """Population loci of called alleles, with how many individuals have them."""
    popall, links = called_links(f)
    n = links.groupBy("poploc").agg(F.count_distinct("ind").alias("n_ind"), F.count_distinct("ind", "loc").alias("n_indloc"))
    cat = population.catalogue(popall).select("poploc", "sl", "cons", "n_snp", "varpos", "n_all")
    return C._long(cat.join(n, "poploc"))


def reads_to_diploid(f: Fixture) -> DataFrame:
    """Diploid genotypes of called alleles; those of more than two alleles, which an exporter rejects, are deselected."""
    _, links = called_links(f)
    gt = Selection.default(population.link_loci(links)).gt
    numbers = export.gt_renumber(export.gt_prune_alleles(links, gt))
    many = links.select("poploc", "ind", "popall").distinct().groupBy("poploc", "ind").agg(F.count(F.lit(1)).alias("n")).filter("n > 2")
    return C._long(export.gt_diploid(links, gt.join(many, ["poploc", "ind"], "left_anti"), numbers))


_CALLED = f"{L._GROUPS[False]}, {L._OK[False]}, called AS (SELECT ind, loc, row_number() OVER (PARTITION BY ind, loc ORDER BY seq)::BIGINT AS all_id, seq, depth, loc_dep FROM al WHERE ok), "

QUERIES = {
    "reads_to_catalogue": (
        reads_to_catalogue,
        (_CALLED + C._LINK).replace("v_alleles", "called") + ", pn AS (SELECT poploc, count(DISTINCT popall) AS n_all, any_value(sl) AS sl FROM pv GROUP BY poploc), kn AS (SELECT poploc, count(DISTINCT ind) AS n_ind, count(DISTINCT (ind, loc)) AS n_indloc FROM lk GROUP BY poploc) SELECT ca.poploc, sl, cons, n_snp, varpos, n_all, n_ind, n_indloc FROM ca JOIN pn ON ca.poploc = pn.poploc JOIN kn ON ca.poploc = kn.poploc",
    ),
    "reads_to_diploid": (reads_to_diploid, (_CALLED + C._DIP).replace("v_alleles", "called") + " SELECT poploc, ind, a1, a2 FROM di WHERE k <= 2"),
}
