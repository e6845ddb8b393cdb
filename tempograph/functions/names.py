"""Run names that encode a configuration, as column expressions.

A name is read once into sections (between colons) and words (between blanks,
commas and brackets); everything else looks a word up by its key, as in K=2, or
by the word before it, as in Seed 42.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIELDS = ("family", "family_tag", "lam", "k", "dir", "topo", "seed", "variation")
#: Sections that wrap another name, models of baselines (text in the name, family), topology words.
WRAPPERS = ("Best WF", "WF Champion")
MODELS = (("XGB", "XGBoost"), ("RandomForest", "RandomForest"), ("IsolationForest", "IsolationForest"), ("Logistic Regression", "LogisticRegression"), ("GCN", "GCN"))
TOPOLOGY = ("none", "early", "late")


def _words(text: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(text, " *= *", "="), "[ ,()]"), lambda w: w != "")


def _keyed(words: Column, key: str) -> Column:
    """Value of the first word ``key=value``, whatever the key's case."""
    hit = F.filter(words, lambda w: F.lower(w).startswith(f"{key}="))
    return F.substring_index(F.get(hit, F.lit(0)), "=", -1)


def _after(words: Column, word: str) -> Column:
    """The word after ``word``."""
    at = F.array_position(words, word)
    return F.when(at > 0, F.get(words, at.cast("int")))


def _digits(c: Column) -> Column:
    return F.when(c.rlike("^[0-9]+$"), c).cast("int")


def _one_of(c: Column, allowed: tuple[str, ...]) -> Column:
    return F.when(F.lower(c).isin(*allowed), c)


def _triple(words: Column) -> Column:
    """Struct (k, dir, topo, next) of the first hop count, direction and topology that follow one another."""
    at = F.sequence(F.lit(0), F.size(words) - 1)
    four = F.transform(at, lambda i: F.struct(_digits(F.get(words, i)).alias("k"), F.upper(F.get(words, i + 1)).alias("dir"), F.get(words, i + 2).alias("topo"), F.get(words, i + 3).alias("next")))
    good = F.filter(four, lambda x: x["k"].between(1, 3) & x["dir"].isin("T", "F") & F.lower(x["topo"]).isin(*TOPOLOGY))
    return F.get(good, F.lit(0))


def _read(x: Column) -> Column:
    """Struct of FIELDS from a struct (name, sections, words)."""
    name, words, sections = x["name"], x["words"], x["sections"]
    inner = F.when(F.get(sections, F.lit(0)).isin(*WRAPPERS), F.get(sections, F.lit(1))).otherwise(F.get(sections, F.lit(0)))
    ablation, baseline, ensemble = (F.get(sections, F.lit(0)) == k for k in ("Ablation", "Baseline", "Ensemble"))
    body = F.get(sections, F.lit(1))
    decay, ipca = ablation & body.startswith("Decay"), ablation & body.startswith("IPCA")
    subject = F.when(decay, F.substring_index(body, " on ", -1))
    on_trees, on_bare, on_grid, on_sweep = subject.startswith("XGBoost"), subject == "NoMP Grid", subject == "Grid", subject.startswith("Sweep ")
    sweep = ~ablation & inner.rlike("^Sweep [0-9]+$")
    bare, grid = ~ablation & F.array_contains(sections, "NoMP Grid"), ~ablation & F.exists(sections, lambda s: s.endswith("Grid"))
    three = _triple(words)
    placed = F.when(decay & ~on_trees & ~on_bare & ~on_grid & ~on_sweep & three["next"].isin("Base", "PCA") | ipca, three)
    keyed = decay & ~on_trees | ipca | sweep | grid & ~baseline
    model = F.lit(None)
    for text, family in reversed(MODELS):
        model = F.when(name.contains(text), family).otherwise(model)
    family = (
        F.when(on_trees, "XGBoost").when(on_bare, "NoMP Grid").when(on_grid, "Grid").when(decay, "SGC").when(ipca, "IPCA").when(baseline, model)
        .when(sweep, F.when(name.contains("MLP Head"), "SGC+MLP").otherwise("SGC")).when(ensemble, "Ensemble")
    )
    tag = F.when(decay | ipca, "Ablation").when(baseline, "Baseline").when(sweep, F.lit(None)).when(bare, "NoMP Grid").when(grid, "Grid").when(ensemble, "Ensemble")
    way = F.coalesce(placed["dir"], F.when(keyed & ~sweep & ~F.coalesce(on_sweep, F.lit(False)), _one_of(F.upper(_keyed(words, "dir")), ("t", "f"))))
    return F.struct(
        family.alias("family"), tag.alias("family_tag"), _number(_keyed(words, "λ")).alias("lam"),
        F.coalesce(placed["k"], F.when(keyed, _digits(_keyed(words, "k")))).alias("k"), (way == "T").alias("dir"),
        F.coalesce(placed["topo"], F.when(keyed, _one_of(_keyed(words, "topo"), TOPOLOGY))).alias("topo"),
        _digits(_after(words, "Seed")).alias("seed"),
        F.coalesce(F.when(decay, placed["next"]), _after(words, "Var")).alias("variation"),
    )


def _number(c: Column) -> Column:
    return F.when(c.rlike("^[0-9]*[.]?[0-9]+$"), c).cast("double")


def parse_name(name: Column) -> Column:
    """Struct of FIELDS; absent parts are null. The name is split once."""
    sections = F.transform(F.split(name, ":"), lambda s: F.trim(s))
    x = F.struct(name.alias("name"), sections.alias("sections"), _words(name).alias("words"))
    return F.transform(F.array(x), _read)[0]


def config_id(name: Column) -> Column:
    """The name without the bracket that holds its variation (and seed)."""
    return F.trim(F.regexp_replace(name, r" *\([^()]*\bVar [^()]*\)", ""))


def without_seed(name: Column) -> Column:
    """The name up to a bracket that begins with its seed; other brackets stay."""
    at = F.locate(" (Seed ", name)
    return F.when(at > 0, F.substring(name, F.lit(1), at - 1)).otherwise(name)


def canonical_grid(name: Column, variation: Column) -> Column:
    """Grid names carry their variation, never their seed; other names give null."""
    own = F.regexp_extract(name, r"\bVar ([^()]*)\)", 1)
    return F.when(name.startswith("Grid:"), F.concat(config_id(name), F.lit(" (Var "), F.coalesce(F.nullif(own, F.lit("")), variation, F.lit("Base")), F.lit(")")))


def grid_target(canonical: Column) -> Column:
    """Struct (base, k, dir, topo, variation) of a canonical grid name, null if it is none."""

    def read(w: Column) -> Column:
        k, way, topo, variation = _digits(_keyed(w, "k")), _keyed(w, "dir"), _keyed(w, "topo"), _after(w, "Var")
        whole = k.isNotNull() & way.isin("T", "F") & F.lower(topo).isin(*TOPOLOGY) & variation.isNotNull() & canonical.startswith("Grid:")
        return F.when(whole, F.struct(config_id(canonical).alias("base"), k.alias("k"), (way == "T").alias("dir"), topo.alias("topo"), variation.alias("variation")))

    return F.transform(F.array(_words(canonical)), read)[0]


def safe_name(name: Column) -> Column:
    """Characters other than letters of any alphabet, digits, _ and - become _."""
    return F.regexp_replace(name, r"[^\p{L}\p{N}_-]", "_")


def with_parsed(df: DataFrame, name_col: str, explicit: dict[str, str] | None = None) -> DataFrame:
    """Add FIELDS parsed from a name; a present explicit column wins over the parsed value."""
    out = df.withColumn("__p", parse_name(F.col(name_col)))
    kinds = {"lam": "double", "k": "int"}
    for f in FIELDS:
        c = F.col(f"__p.{f}")
        if explicit and f in explicit and explicit[f] in df.columns:
            x = F.col(explicit[f])
            x = F.expr(f"try_cast(`{explicit[f]}` as {kinds[f]})") if f in kinds else F.when(~x.isin("", "N/A"), x).cast("boolean" if f == "dir" else "string")
            c = F.coalesce(x, c)
        out = out.withColumn(f"_{f}", c)
    return out.drop("__p")


def matches(**want) -> Column:
    """Conjunction of null-safe equalities on parsed fields; ``decay`` asks whether lam is present."""
    c = F.lit(True)
    for f, v in want.items():
        c = c & (F.col("_lam").isNotNull() == F.lit(v) if f == "decay" else F.col(f"_{f}").eqNullSafe(F.lit(v)))
    return c


def split_name(name: Column) -> Column:
    """Struct (arch, k, dir, topo) of ``Grid: ...`` and ``MLP-<arch> [...]`` names, by splitting their parameters; defaults for absent parts."""
    inner = F.when(name.startswith("Grid:"), F.regexp_replace(name, "^Grid: *", "")).otherwise(F.regexp_extract(name, r"^MLP-[A-Za-z]+ \[(.*)\]", 1))
    arch = F.nullif(F.regexp_extract(name, r"^MLP-([A-Za-z]+) \[", 1), F.lit(""))
    parts = F.map_from_entries(F.transform(F.filter(F.split(inner, ", "), lambda x: x.contains("=")), lambda x: F.struct(F.substring_index(x, "=", 1), F.substring_index(x, "=", -1))))

    def read(m: Column) -> Column:
        k = F.try_element_at(m, F.lit("K")).cast("string").try_cast("int")
        return F.struct(F.coalesce(arch, F.lit("Linear")).alias("arch"), F.coalesce(k, F.lit(1)).alias("k"), F.coalesce(F.try_element_at(m, F.lit("Dir")), F.lit("F")).alias("dir"), F.coalesce(F.try_element_at(m, F.lit("Topo")), F.lit("None")).alias("topo"))

    return F.transform(F.array(parts), read)[0]


def safe_member(value: Column, allowed: list[int]) -> Column:
    """Whether a text is one of some whole numbers; text that is none, and null, are not."""
    return F.coalesce(value.try_cast("int").isin(allowed), F.lit(False))
