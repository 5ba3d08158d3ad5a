"""Spectral libraries: digestion, decoys, channels, fragments, and libraries from results."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peakloom.functions.scalars import ISOTOPE, PROTON, translate_mods

from .joins import lookup_with_fallback, only_keys
from .ranking import keep_best, quantiles

# Monoisotopic residue masses, mass of water, and a public residue exchange.
RESIDUES = {
    "G": 57.021464, "A": 71.037114, "S": 87.032028, "P": 97.052764, "V": 99.068414, "T": 101.047679, "C": 103.009185, "L": 113.084064, "I": 113.084064, "N": 114.042927,
    "D": 115.026943, "Q": 128.058578, "K": 128.094963, "E": 129.042593, "M": 131.040485, "H": 137.058912, "F": 147.068414, "R": 156.101111, "Y": 163.063329, "W": 186.079313,
}
WATER = 18.010565
# Atoms of residues and of common modifications, and natural shares of isotopes.
COMPOSITIONS = {
    "G": "C2H3NO", "A": "C3H5NO", "S": "C3H5NO2", "P": "C5H7NO", "V": "C5H9NO", "T": "C4H7NO2", "C": "C3H5NOS", "L": "C6H11NO", "I": "C6H11NO", "N": "C4H6N2O2",
    "D": "C4H5NO3", "Q": "C5H8N2O2", "K": "C6H12N2O", "E": "C5H7NO3", "M": "C5H9NOS", "H": "C6H7N3O", "F": "C9H9NO", "R": "C6H12N4O", "Y": "C9H9NO2", "W": "C11H10N2O",
}
MODIFICATIONS = {"Carbamidomethyl": "C2H3NO", "Oxidation": "O", "Acetyl": "C2H2O", "Phospho": "HO3P", "Deamidated": "H-1N-1O", "Methyl": "CH2", "Dimethyl": "C2H4"}
ELEMENTS = {
    "C": (0.9893, 0.0107), "H": (0.999885, 0.000115), "N": (0.99636, 0.00364), "O": (0.99757, 0.00038, 0.00205), "S": (0.9499, 0.0075, 0.0425, 0.0, 0.0001), "P": (1.0,),
}
EXCHANGE = ("GAVLIFMPWSCTYHKRQEND", "LLLVVLLLLTSSSSLLNDQE")


def digest(proteins: DataFrame, *, missed: int = 1, length: tuple[int, int] = (7, 35)) -> DataFrame:
    """Tryptic peptides of (protein, sequence): peptide and the proteins that hold it.

    Cleavage is after K or R unless P follows. Peptides with B, J, X or Z are left out.
    """
    parts = F.split(F.regexp_replace("sequence", "(?<=[KR])(?!P)", "|"), r"\|")
    pieces = proteins.select("protein", F.filter(parts, lambda p: p != "").alias("parts")).where(F.size("parts") > 0)
    spans = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(missed + 1)), lambda n: F.transform(
        F.filter(F.sequence(F.lit(1), F.size("parts")), lambda i: i + n - 1 <= F.size("parts")), lambda i: F.array_join(F.slice("parts", i, n), ""))))
    each = pieces.select("protein", F.explode(F.array_distinct(spans)).alias("peptide"))
    sized = each.where(F.length("peptide").between(*length) & ~F.col("peptide").rlike("[BJXZ]"))
    return sized.groupBy("peptide").agg(F.array_join(F.array_sort(F.collect_set("protein")), ";").alias("proteins"))


#: Letters in which peptides may begin: of a piece of a sequence, and of a part of a piece.
PIECE, PART = 500, 32


def annotate(peptides: DataFrame, proteins: DataFrame, *, k: int = 6, heavy: int = 500_000) -> DataFrame:
    """Proteins (protein, sequence) that hold each of ``peptides`` (peptide) anywhere: peptide and their names, joined by ;.

    Peptides are broadcast by their first ``k`` letters (all, if fewer), about ``heavy`` of them at
    a time; every run of a sequence is looked up there, and where it is found the whole peptide is
    compared at that place. So sequences are read in place and only matches are shuffled. Empty
    peptides and those of no protein are left out; repeated names count once.
    """
    wanted = peptides.where(F.length("peptide") > 0).select("peptide").distinct()
    size = F.least(F.length("peptide"), F.lit(k))
    facts = wanted.groupBy(size.alias("n")).agg(F.count("*").alias("peptides"), F.max(F.length("peptide")).alias("longest")).collect()  # k rows at most
    if not facts:
        return wanted.select("peptide", F.lit("").alias("proteins"))
    sizes, longest = sorted(r["n"] for r in facts), max(r["longest"] for r in facts)
    rounds = -(-sum(r["peptides"] for r in facts) // heavy)
    # A place in a text is found by walking to it, so long texts are cut twice, into pieces that overlap by a peptide.
    texts = proteins.where((F.length("sequence") > 0) & F.col("protein").isNotNull()).select("protein", F.col("sequence").alias("piece"))
    cores = texts.sparkSession.sparkContext.defaultParallelism
    if texts.rdd.getNumPartitions() < cores:
        texts = texts.repartition(cores)
    letters = F.length("piece")
    for step in (max(PIECE, longest), max(PART, longest)):
        starts = F.sequence(F.lit(0), F.floor((letters - 1) / step))
        cut = F.transform(starts, lambda i: F.substring("piece", (i * step + 1).cast("int"), F.lit(step + longest - 1)))  # noqa: B023
        texts = texts.select("protein", F.explode(cut).alias("piece"))
        letters = F.least(F.length("piece"), F.lit(step))  # what overlaps begins in the next piece
    places = texts.select("protein", "piece", F.explode(F.sequence(F.lit(1), letters)).alias("i"))
    runs = places.select("protein", "piece", "i", F.explode(F.array(*(F.substring(F.col("piece"), F.col("i"), F.lit(n)) for n in sizes))).alias("run"))
    named = wanted.select("peptide", F.substring("peptide", 1, k).alias("run"))
    whole = F.substring(F.col("piece"), F.col("i"), F.length("peptide")) == F.col("peptide")
    found = [
        runs.join(F.broadcast(named.where(F.pmod(F.xxhash64("peptide"), F.lit(rounds)) == r) if rounds > 1 else named), "run").where(whole).select("peptide", "protein")
        for r in range(rounds)
    ]
    pairs = reduce(DataFrame.union, found)
    return pairs.groupBy("peptide").agg(F.array_join(F.array_sort(F.collect_set("protein")), ";").alias("proteins"))


def peptide_mass(sequence: Column) -> Column:
    """Mass of an unmodified peptide."""
    masses = F.create_map(*(F.lit(x) for kv in RESIDUES.items() for x in kv))
    return F.aggregate(F.transform(F.split(sequence, ""), lambda c: F.coalesce(F.element_at(masses, c), F.lit(0.0))), F.lit(WATER), lambda s, m: s + m)


def with_charges(peptides: DataFrame, charges: list[int], mz: tuple[float, float]) -> DataFrame:
    """A row per peptide and charge whose m/z lies in the range."""
    rows = peptides.withColumn("charge", F.explode(F.array(*map(F.lit, charges))))
    return rows.withColumn("mz", (peptide_mass(F.col("peptide")) + F.col("charge") * PROTON) / F.col("charge")).where(F.col("mz").between(*mz))


def place_of(residue: str) -> str | None:
    """Residue of a modification "name@residue", or None for the first residue's end ("Any_N-term")."""
    return None if residue.endswith("N-term") else residue


def modify(peptides: DataFrame, *, fixed: dict[str, float], variable: dict[str, float], most: int = 2) -> DataFrame:
    """Peptides with all fixed and each choice of up to ``most`` variable modifications.

    Modifications are named "name@residue" (or "name@Any_N-term", at place 0) with their mass;
    a place holds one of them, so variable ones skip places that a fixed one takes. Adds mods
    and mod_sites (joined by ;, fixed ones first) and mod_mass.
    """

    none = F.array().cast("array<struct<place:int,name:string,mass:double>>")

    def places_of(name: str, mass: float) -> Column:
        residue = place_of(name.split("@")[1])
        places = F.array(F.lit(0)) if residue is None else F.filter(F.sequence(F.lit(1), F.length("peptide")), lambda i: F.substring(F.col("peptide"), i, F.lit(1)) == residue)
        return F.transform(places, lambda i: F.struct(i.cast("int").alias("place"), F.lit(name).alias("name"), F.lit(float(mass)).alias("mass")))

    def sites(mods: dict[str, float]) -> Column:
        return F.array_sort(F.concat(none, *(places_of(n, m) for n, m in sorted(mods.items()))))

    # A form is built from a shorter one by one more place after its last: names and places joined by ;, and mass.
    after = lambda form, s: F.struct(
        s["place"].alias("last"), F.concat_ws(";", form["mods"], s["name"]).alias("mods"), F.concat_ws(";", form["sites"], s["place"].cast("string")).alias("sites"), (form["mass"] + s["mass"]).alias("mass")
    )
    kind = "struct<last:int,mods:string,sites:string,mass:double>"
    rows = peptides.where(F.length("peptide") > 0)
    cores = rows.sparkSession.sparkContext.defaultParallelism
    if rows.rdd.getNumPartitions() < cores:  # rows grow manifold here
        rows = rows.repartition(cores)
    rows = rows.withColumn("_fixed", sites(fixed))
    free = F.filter(sites(variable), lambda s: ~F.exists("_fixed", lambda f: f["place"] == s["place"]))
    start = F.aggregate("_fixed", F.struct(F.lit(-1).alias("last"), F.lit(None).cast("string").alias("mods"), F.lit(None).cast("string").alias("sites"), F.lit(0.0).alias("mass")).cast(kind), lambda f, s: after(f, s).cast(kind))
    rows = rows.withColumn("_free", free).withColumn("_start", start)
    rows = rows.withColumn("_start", F.struct(F.lit(-1).alias("last"), "_start.mods", "_start.sites", "_start.mass").cast(kind)).withColumn("_form0", F.array("_start"))
    longer = lambda form: F.transform(F.filter("_free", lambda s: s["place"] > form["last"]), lambda s: after(form, s).cast(kind))
    for i in range(most):
        rows = rows.withColumn(f"_form{i + 1}", F.flatten(F.transform(f"_form{i}", longer)))
    layers = [f"_form{i}" for i in range(most + 1)]
    each = rows.withColumn("_all", F.explode(F.concat(*layers)))
    each = each.withColumns({"mods": F.coalesce("_all.mods", F.lit("")), "mod_sites": F.coalesce("_all.sites", F.lit("")), "mod_mass": F.col("_all.mass")})
    return each.drop("_fixed", "_free", "_start", "_all", *layers)


def mutate(sequence: Column) -> Column:
    """Decoy sequence: the second and the second last residue are exchanged."""
    swap = lambda c: F.translate(c, *EXCHANGE)
    n = F.length(sequence)
    changed = F.concat(F.substring(sequence, 1, 1), swap(F.substring(sequence, 2, 1)), F.substring(sequence, F.lit(3), n - 4), swap(F.substring(sequence, n - 1, F.lit(1))), F.substring(sequence, n, F.lit(1)))
    return F.when(n >= 5, changed).otherwise(sequence)


def add_decoys(library: DataFrame, sequence: str = "sequence") -> DataFrame:
    """Targets and, for each, a decoy with a mutated sequence."""
    targets = library.withColumn("decoy", F.lit(0))
    return targets.unionByName(targets.withColumn(sequence, mutate(F.col(sequence))).withColumn("decoy", F.lit(1)))


def fragments(library: DataFrame, *, idx: str = "precursor_idx", sequence: str = "sequence") -> DataFrame:
    """Singly charged b and y fragments: (idx, type, number, mz_library)."""
    n = F.length(sequence)
    number = F.explode(F.sequence(F.lit(1), n - 1))
    rows = library.where(n > 1).select(idx, sequence, number.alias("number"))
    b = peptide_mass(F.substring(F.col(sequence), F.lit(1), F.col("number"))) - WATER + PROTON
    y = peptide_mass(F.substring(F.col(sequence), F.length(sequence) - F.col("number") + 1, F.col("number"))) + PROTON
    both = F.explode(F.array(F.struct(F.lit("b").alias("type"), b.alias("mz")), F.struct(F.lit("y").alias("type"), y.alias("mz"))))
    return rows.select(idx, "number", both.alias("f")).select(idx, "f.type", "number", F.col("f.mz").alias("mz_library"))


def all_fragments(library: DataFrame, *, charges: tuple[int, ...] = (1, 2), idx: str = "precursor_idx", sequence: str = "sequence") -> DataFrame:
    """Every b and y fragment in each charge, all of intensity 1, to quantify anew."""
    each = fragments(library, idx=idx, sequence=sequence).withColumn("charge", F.explode(F.array(*map(F.lit, charges))))
    mz = (F.col("mz_library") - PROTON) / F.col("charge") + PROTON
    return each.withColumn("mz_library", mz).withColumn("intensity_library", F.lit(1.0))


def unshared_ions(ions: DataFrame, *, group: str = "elution_group_idx", channel: str = "channel", mz: str = "mz_library", digits: int = 4) -> DataFrame:
    """Ions whose m/z, rounded, belongs to one channel of the group only."""
    named = ions.withColumn("_mz", F.round(mz, digits))
    alone = named.groupBy(group, "_mz").agg(F.min(channel).alias("_least"), F.max(channel).alias("_most")).where("_least = _most")
    return named.join(alone.select(group, "_mz"), [group, "_mz"], "left_semi").drop("_mz")


def with_reference(rows: DataFrame, reference: int, *, group: str = "elution_group_idx", channel: str = "channel") -> DataFrame:
    """Rows of the groups that have the reference channel."""
    return only_keys(rows, rows.where(F.col(channel) == reference).select(group).distinct(), [group])


def observed_library(psm: DataFrame, run: str) -> DataFrame:
    """Targets of a run as a library; rt, mz and mobility are the observed, else the calibrated,
    else the library's column, by what the table has."""
    out = psm.where(F.col("decoy") == 0).withColumn("run", F.lit(run))
    for value in ("rt", "mz", "mobility"):
        named = [c for c in (f"{value}_observed", f"{value}_calibrated", f"{value}_library") if c in psm.columns]
        if not named:
            raise ValueError(f"no column for {value}")
        out = out.withColumn(value, F.col(named[0]))
    return hash_precursors(out)


def formula_of(text: str) -> dict[str, int]:
    """Atoms of a formula such as C2H3NO; a count may be negative (O-1H-2)."""
    return {e: int(n or 1) for e, n in re.findall(r"([A-Z][a-z]?)(-?[0-9]*)", text)}


def composition(sequence: Column, mods: Column | None = None, formulas: dict[str, str] | None = None) -> Column:
    """Atoms of a peptide with its modifications: an array in the order of ELEMENTS.

    ``mods`` names modifications joined by ; ("name@residue"); ``formulas`` gives what each name
    adds (MODIFICATIONS by default). Letters that are no residue, and unknown names, add nothing.
    """
    order = list(ELEMENTS)
    atoms = lambda text: F.array(*(F.lit(float(formula_of(text).get(e, 0))) for e in order))
    table = lambda named: F.create_map(*(x for k, v in named.items() for x in (F.lit(k), atoms(v))))
    add = lambda s, v: F.zip_with(s, v, lambda x, y: x + y)
    known = lambda parts, named: F.filter(F.transform(parts, lambda c: F.try_element_at(named, c)), lambda v: v.isNotNull())
    out = F.aggregate(known(F.split(sequence, ""), table(COMPOSITIONS)), atoms("H2O"), add)
    if mods is None:
        return out
    names = F.transform(F.split(F.coalesce(mods, F.lit("")), ";"), lambda m: F.split(m, "@")[0])
    return F.aggregate(known(names, table(formulas or MODIFICATIONS)), out, add)


def _power(atoms: Column, shares: tuple[float, ...], n: int) -> Column:
    """First ``n`` heights of so many atoms of one element: its polynomial to that power, by recurrence."""
    first, ratios = shares[0], [s / shares[0] for s in shares[1:]]

    def grow(c: Column, k: Column) -> Column:
        terms = [F.when(k >= i, (i * (atoms + 1) - k) * r * F.coalesce(F.get(c, (k - i).cast("int")), F.lit(0.0))).otherwise(0.0) for i, r in enumerate(ratios, 1) if r]
        return F.concat(c, F.array(sum(terms, F.lit(0.0)) / k))

    start = F.array(F.pow(F.lit(first), atoms))
    return F.aggregate(F.sequence(F.lit(1), F.lit(n - 1)), start, grow) if n > 1 else start


def _convolved(x: Column, y: Column, n: int) -> Column:
    """First ``n`` terms of the product of two series."""

    def product(p: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.aggregate(F.sequence(F.lit(0), k), F.lit(0.0), lambda s, i: s + F.get(p["x"], i) * F.get(p["y"], k - i)))

    return F.element_at(F.transform(F.array(F.struct(x.alias("x"), y.alias("y"))), product), 1)


def isotope_pattern(sequence: Column, n: int = 4, mods: Column | None = None, formulas: dict[str, str] | None = None) -> Column:
    """Relative heights of the first ``n`` isotopes of a peptide, by its elements.

    Each element's isotopes are raised to its number of atoms, and the elements are convolved;
    heights sum to one over the isotopes given. A null sequence gives null.
    """

    def of(atoms: Column) -> Column:
        parts = [_power(F.element_at(atoms, i), shares, n) for i, shares in enumerate(ELEMENTS.values(), 1)]
        out = parts[0]
        for part in parts[1:]:
            out = _convolved(out, part, n)
        return out

    heights = F.element_at(F.transform(F.array(composition(sequence, mods, formulas)), of), 1)
    scaled = lambda h: F.transform(h, lambda v: v / F.aggregate(h, F.lit(0.0), lambda s, x: s + x))
    return F.element_at(F.transform(F.array(heights), scaled), 1)


def multiplex_library(library: DataFrame, channels: dict[str, dict[str, str]], mods: str = "mods") -> DataFrame:
    """A copy of the library per channel, with modifications translated."""
    parts = [library.withColumn(mods, translate_mods(F.col(mods), names)).withColumn("channel", F.lit(c)) for c, names in channels.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def match_between_runs(psm: DataFrame, library: DataFrame, *, fdr: float = 0.01, keep_decoys: bool = False) -> DataFrame:
    """Library of the elution groups found at ``fdr``, with their observed times and groups.

    An entry takes the median of its own hash, else that of its elution group.
    """
    found = psm.where(F.col("qval") <= fdr)
    named = found if keep_decoys else found.where("decoy = 0")
    kept = only_keys(library, named.select("elution_group_idx").distinct(), ["elution_group_idx"])
    by_hash = found.groupBy("mod_seq_charge_hash").agg(F.median("rt_observed").alias("rt"))
    by_group = found.groupBy("elution_group_idx").agg(F.median("rt_observed").alias("rt"))
    timed = lookup_with_fallback(kept, by_hash, by_group, key="mod_seq_charge_hash", fallback_key="elution_group_idx", value="rt", out="rt_library")
    groups = named.groupBy("elution_group_idx").agg(F.min_by("pg", F.struct("mod_seq_charge_hash", "pg")).alias("pg"))
    return timed.join(groups, "elution_group_idx", "left")


def transfer_library(psm: DataFrame, *, keep_top: int = 3) -> DataFrame:
    """The best rows per modified sequence across runs, with normalised times."""
    best = keep_best(psm.where("decoy = 0"), ["mod_seq_hash"], ["proba", "run", "precursor_idx"], keep_top)
    most = best.agg(F.max("rt_observed").alias("_most"))
    return best.join(F.broadcast(most)).withColumn("rt_norm", F.col("rt_observed") / F.col("_most")).drop("_most")  # most is one row


def blend_times(df: DataFrame, observed: str, calibrated: str, out: str = "rt_norm") -> DataFrame:
    """Max-normalised times m and c blended as (1 - m) c + m m."""
    most = df.agg(F.max(observed).alias("_o"), F.max(calibrated).alias("_c"))
    m, c = F.col(observed) / F.col("_o"), F.col(calibrated) / F.col("_c")
    return df.join(F.broadcast(most)).withColumn(out, (1 - m) * c + m * m).drop("_o", "_c")  # most is one row


def clip_times(df: DataFrame, value: str, lo: float = 0.001, hi: float = 0.999) -> DataFrame:
    """Values limited to two of their percentiles."""
    least, most = quantiles(df, value, [lo, hi])
    return df.withColumn(value, F.least(F.greatest(F.col(value), F.lit(least)), F.lit(most)))


def isotope_window(mz: Column, charge: Column, n: int) -> tuple[Column, Column]:
    """Range of m/z that the first ``n`` isotopes span."""
    return mz, mz + (n - 1) * ISOTOPE / charge


def hash_precursors(psm: DataFrame) -> DataFrame:
    """Cleaned modifications (null is none) and the keys mod_seq_hash and mod_seq_charge_hash.

    ``psm`` has sequence, mods, mod_sites and charge.
    """
    clean = psm.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("mods", "mod_sites")})
    named = clean.withColumn("mod_seq_hash", F.xxhash64("sequence", "mods", "mod_sites"))
    return named.withColumn("mod_seq_charge_hash", F.xxhash64("sequence", "mods", "mod_sites", F.col("charge").cast("long")))
