"""Problem 5: generated, minified, vendored and data files, by belief propagation over directory trees.

Each file is a leaf of its index's directory tree.  Its own evidence (markers in its
leading and trailing comments, file name, line and character statistics, numbered families of
functions, data literals, a library's banner, a body that also occurs in a vendored
place) is a vector of soft log-potentials over the labels; a directory's name is one too.
Files of one directory and extension are siblings: they hang on one hidden node, which hangs on
the directory, which hangs on its parent; each edge has its compatibility table, so evidence
too weak to decide alone is decided by siblings, and what a vendored directory says reaches
everything below it.  All this is a tree, on which sum-product propagation is exact.

Messages of files are summed by sibling group and directory with partial aggregation, so only
directories go on, and text is never shuffled.  A tree is propagated in blocks: a block is a
subtree of at most ``BLOCK`` directories, done in one task in one pass; an index with more is cut into such
subtrees, whose roots exchange one message each with the directories above them
(few: each has over ``BLOCK`` below it).  The number of jobs does not depend on the depth.

Defined results: null code has no content evidence; an empty file is handwritten unless
its place says otherwise; a file below a directory named in ``ignored_dirs`` is always
reported, as ``ignored``; null paths are dropped; repeated rows count once; paths may use
either separator.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.session import cut_lineage, small

from .current import newest

LABELS = ("handwritten", "generated", "minified", "vendored", "blob")
#: log P(child's label | parent's label), rows and columns as LABELS: files given their siblings' node, that given its directory, directories given theirs.
FILE_GIVEN_GROUP = np.log([
    (0.70, 0.04, 0.02, 0.22, 0.02),
    (0.25, 0.71, 0.01, 0.01, 0.02),
    (0.25, 0.01, 0.71, 0.01, 0.02),
    (0.02, 0.02, 0.02, 0.92, 0.02),
    (0.25, 0.01, 0.01, 0.01, 0.72),
])
GROUP_GIVEN_DIR = np.log([
    (0.90, 0.04, 0.02, 0.02, 0.02),
    (0.30, 0.66, 0.01, 0.01, 0.02),
    (0.30, 0.01, 0.66, 0.01, 0.02),
    (0.01, 0.01, 0.01, 0.96, 0.01),
    (0.30, 0.02, 0.01, 0.01, 0.66),
])
DIR_GIVEN_DIR = np.log([
    (0.88, 0.03, 0.02, 0.05, 0.02),
    (0.47, 0.50, 0.01, 0.01, 0.01),
    (0.47, 0.01, 0.50, 0.01, 0.01),
    (0.01, 0.01, 0.01, 0.96, 0.01),
    (0.47, 0.01, 0.01, 0.01, 0.50),
])
BLOCK = 50_000
"""Most directories that one task propagates at once."""
# Names of directories that hold third-party code.
VENDOR_DIRS = ("vendor", "vendors", "vendored", "third_party", "third-party", "thirdparty", "3rdparty", "3rd_party", "extern", "external", "externals", "deps", "bower_components", "site-packages", "jspm_packages", "Pods", "Godeps")
# Names of directories that hold output of tools.
OUTPUT_DIRS = ("generated", "__generated__", "gen", "autogen", "dist", "out")

_PY_HEAD = re.compile(r"(?:\s|#[^\n]*|[rRuU]?\"\"\"(?:[^\"\\]|\\.|\"(?!\"\"))*\"\"\"|[rRuU]?'''(?:[^'\\]|\\.|'(?!''))*''')*+")
_C_HEAD = re.compile(r"(?:\s|//[^\n]*|/\*(?:[^*]|\*(?!/))*+\*/)*+")
_TOOL = re.compile(
    r"(?im)^[\s/*#!;-]*(?:.*\b)?(?:@generated\b|<auto-?generated\b|auto-?generated by\b|(?:code|file|source|class|content)s? (?:is |was |has been |were )?(?:auto(?:matically)?[- ]?|machine[- ])?(?:generated|produced|created|emitted) (?:automatically |with |by |from |using )"
    r"|(?:generated|produced|created|emitted) (?:automatically|by (?!hand)|from |with )|automatically (?:generated|produced|created)|machine[- ](?:made|generated|written)"
    r"|do not (?:edit|modify|change)(?: (?:this|by hand|manually|it)|[.!]|\s*$)|manual changes will be lost|(?:re-?run|regenerate) (?:it|this)\b[^\n]* (?:rather than|instead)|edit (?:that|the) (?:file|source|template|schema)[^\n]* instead|output of `|(?:automatisch|maschinell) (?:erzeugt|generiert|erstellt)"
    r"|(?:généré|produit|créé) automatiquement|ne pas (?:modifier|éditer)|(?:generado|creado) automáticamente|no (?:editar|modificar)|wygenerowan\w+ automatycznie|автоматически|自動生成|自动生成)"
)
_COMMENT_LINE = re.compile(r"[ \t]*(?:(?://|#|\*|/\*)[^\n]*)?\Z")
#: What suggests a tool without saying so.
_HINT = re.compile(r"(?im)^[\s/*#!;-]*(?:schema|template|spec|protocol|source) ?(?:version|file|hash)?\s*[:=]|\b(?:codegen|stub(?:s| file)|bindings)\b")
WEAK = 4.6
"""Evidence that does not decide alone against ``handwritten`` siblings, but does beside others of its kind."""
_QUOTED = re.compile(r"'[^'\n]{3,60}'|\"[^\"\n]{3,60}\"|“[^”\n]{3,60}”")
_WRITER = re.compile(r"(?im)^[\s/*#]*(?:this (?:script|module|tool|file|program|class) )?(?:writes?|emits?|generates|produces|creates|minif(?:y|ies)|builds|renders|strips|checks|finds|detects)\b")
_BANNER = re.compile(r"(?m)^[\s/*#!]*[A-Za-z][\w.-]* v?\d+\.\d+(?:\.\d+)?(?:[-+.][\w.]+)?\s*(?:$|\||-|–|\()")
_LICENSED = re.compile(r"(?i)\b(?:MIT|BSD|Apache|GPL|LGPL|MPL|ISC)\b|\(c\) ?\d{4}|copyright \(c\)|upstream:|homepage:")
_NUMBERS = re.compile(r"(?:-?(?:0x[0-9a-fA-F]+|\d[\d.eE]*)[fFuUlL]?[,\s;]+){8,}")
_DATA_STRING = re.compile(r"[\"'`](?:[A-Za-z0-9+/=_-]|\\x[0-9a-fA-F]{2}|\\n){40,}[\"'`]")
_FAMILY = re.compile(r"\b(?:def|func|fn|function|int|long|void|bool|auto|double|String|static)\s+[A-Za-z_]\w*?_?\d+\s*\(")
_FUNCTION = re.compile(r"\b(?:def|func|fn|function)\s+\w+|\)\s*(?:const\s*)?\{|=>\s*\{")
_MADE_NAME = re.compile(r"(?i)(?:\.(?:generated|gen|g|pb|designer|autogen)\.\w+|_(?:pb2?|pb2_grpc|gen|generated)\.\w+|\.pb\.(?:go|cc|h))$")
_MIN_NAME = re.compile(r"(?i)[.-](?:min|bundle)\.(?:js|ts|css|mjs)$|\.bundle\.js$")


def _foot(text: str) -> str:
    """The trailing lines that are comments or blank."""
    at = len(text)
    while at > 0:
        start = text.rfind("\n", 0, at - 1) + 1
        if _COMMENT_LINE.match(text[start:at].rstrip("\n")) is None:
            break
        at = start
    return text[at:]


def evidence(code: str | None, path: str) -> tuple[list[float], str, int]:
    """Log-potentials of a file's label by its own text and name, and a digest of its body without leading comments (none of an empty body)."""
    name = re.split(r"[/\\]", path)[-1]
    phi = [0.0, -4.0, -5.0, -1.0, -5.0]
    if _MADE_NAME.search(name):
        phi[1] += 7.5
    if _MIN_NAME.search(name):
        phi[2] += 8.0
    if not code:
        return phi, "", 0
    text = code.replace("\r\n", "\n")
    markdown = name.lower().endswith((".md", ".markdown"))
    head = (_PY_HEAD if name.endswith((".py", ".sh", ".rb", ".yml", ".yaml", ".toml")) else _C_HEAD).match(text).group()
    body = text[len(head) :].strip()
    digest = hashlib.blake2b(body.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest() if body else ""
    if markdown:
        return phi, digest, len(body)
    n = len(text)
    foot = _foot(text)
    if head or foot:
        said = "\n".join(line for line in _QUOTED.sub(lambda m: m.group() if "@" in m.group() or "<" in m.group() else "''", head + "\n" + foot).split("\n") if not _WRITER.match(line))
        if _TOOL.search(said):
            phi[1] += 12.0
        elif _HINT.search(said):
            phi[1] += WEAK
        if _BANNER.search(head) and (_LICENSED.search(head) or _BANNER.match(head)):
            phi[3] += 8.0
    data = sum(m.end() - m.start() for m in _NUMBERS.finditer(text)) + sum(m.end() - m.start() for m in _DATA_STRING.finditer(text))
    if data > 0.6 * n and n > 300:
        phi[4] += 13.0
    elif data > 0.35 * n and n > 300:
        phi[4] += WEAK
    else:
        long = sum(len(line) for line in body.split("\n") if len(line) > 120)
        if long > 0.6 * len(body) and len(body) > 300:
            blank = sum(body.count(c) for c in " \t\n") / len(body)
            if blank < 0.10:
                phi[2] += 13.0
            elif blank < 0.14:
                phi[2] += WEAK
        family = len(_FAMILY.findall(text))
        if family >= 4 and family >= 0.5 * max(1, len(_FUNCTION.findall(text)) - family):
            phi[1] += 9.0
        elif family >= 2 and family >= 0.5 * max(1, len(_FUNCTION.findall(text)) - family):
            phi[1] += WEAK - 1.0
    return phi, digest, len(body)


@F.pandas_udf(T.StructType([T.StructField("phi", T.ArrayType(T.DoubleType())), T.StructField("body", T.StringType()), T.StructField("size", T.IntegerType())]))
def _evidence(code: pd.Series, path: pd.Series) -> pd.DataFrame:
    rows = [evidence(c, p or "") for c, p in zip(code, path)]
    return pd.DataFrame({"phi": [r[0] for r in rows], "body": [r[1] for r in rows], "size": [r[2] for r in rows]})


def to_parent(belief: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Messages about the parents' labels from beliefs about the children's, shifted to a greatest value of 0."""
    z = belief[:, None, :] + table[None, :, :]
    top = z.max(2)
    out = top + np.log(np.exp(z - top[:, :, None]).sum(2))
    return out - out.max(1, keepdims=True)


def to_child(belief: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Messages about the children's labels from beliefs about the parents'."""
    return to_parent(belief, table.T)


S = [f"s{k}" for k in range(5)]
_FIVE = T.StructType([T.StructField(c, T.DoubleType()) for c in S])


def _five(m: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame(m.reshape(-1, 5), columns=S)


def _rows(x: pd.Series) -> np.ndarray:
    return np.stack(x.to_numpy()) if len(x) else np.empty((0, 5))


@F.pandas_udf(_FIVE)
def _from_file(phi: pd.Series) -> pd.DataFrame:
    return _five(to_parent(_rows(phi), FILE_GIVEN_GROUP))


@F.pandas_udf(_FIVE)
def _from_group(*s: pd.Series) -> pd.DataFrame:
    return _five(to_parent(np.stack([x.to_numpy() for x in s], 1), GROUP_GIVEN_DIR))


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _group_belief(s: pd.DataFrame, belief: pd.Series) -> pd.Series:
    """A sibling group's belief: what its files and its directory (without this group) say."""
    own = s[S].to_numpy()
    return pd.Series(list(own + to_child(_rows(belief) - to_parent(own, GROUP_GIVEN_DIR), GROUP_GIVEN_DIR)))


@F.pandas_udf(T.StructType([T.StructField("label", T.StringType()), T.StructField("log_odds", T.DoubleType())]))
def _labels(phi: pd.Series, belief: pd.Series) -> pd.DataFrame:
    own = _rows(phi)
    score = own + to_child(_rows(belief) - to_parent(own, FILE_GIVEN_GROUP), FILE_GIVEN_GROUP)
    best = score.argmax(1) if len(score) else np.empty(0, int)
    return pd.DataFrame({"label": [LABELS[k] for k in best], "log_odds": (score[:, 1:].max(1) - score[:, 0] if len(score) else np.empty(0)).round(4)})


_LIBRARY_DIR = re.compile(r"@?[A-Za-z][\w.]*-v?\d+\.\d+(\.\d+)*([-.]\w+)?")


def place(name: str) -> list[float]:
    """Log-potentials of a directory's label by its name."""
    vendored = name in VENDOR_DIRS or _LIBRARY_DIR.fullmatch(name) is not None
    return [3.0, 2.0 if name in OUTPUT_DIRS else 0.0, 0.0, 16.0 if vendored else 0.0, 0.0]


def propagate(names: list[str], said: np.ndarray, top: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Beliefs of all directories of a subtree and its root's message upwards; ``said``: what each one's groups and
    cut-off subtrees say, ``top``: what the root's parent says.  The root is the shortest path."""
    order = sorted(range(len(names)), key=lambda k: names[k].count("/") + (names[k] != ""))
    at = {names[k]: k for k in order}
    depth = np.array([n.count("/") + (n != "") for n in names])
    parent = np.array([at.get(n.rpartition("/")[0], -1) if k != order[0] else -1 for k, n in enumerate(names)])
    belief = said + np.array([place(n.rpartition("/")[2]) for n in names])
    sent = np.zeros_like(belief)
    for d in sorted(set(depth.tolist()), reverse=True):
        k = np.flatnonzero(depth == d)
        sent[k] = to_parent(belief[k], DIR_GIVEN_DIR)
        k = k[parent[k] >= 0]
        np.add.at(belief, parent[k], sent[k])
    if top is not None:
        belief[order[0]] += top
    for d in sorted(set(depth.tolist())):
        k = np.flatnonzero((depth == d) & (parent >= 0))
        belief[k] += to_child(belief[parent[k]] - sent[k], DIR_GIVEN_DIR)
    return belief, sent[order[0]]


def _block(pdf: pd.DataFrame) -> pd.DataFrame:
    top = pdf[pdf["dir"].isna()]
    pdf = pdf[pdf["dir"].notna()]
    belief, up = propagate(pdf["dir"].tolist(), pdf[S].to_numpy(), top[S].to_numpy()[0] if len(top) else None)
    return pd.DataFrame({"index_prefix": pdf["index_prefix"], "block": pdf["block"], "dir": pdf["dir"], "belief": list(belief), "up": [up.tolist()] * len(pdf)})


_BELIEFS = "index_prefix string, block string, dir string, belief array<double>, up array<double>"
_ANCESTORS = "transform(sequence(0, size(split(dir, '/')) - 1), n -> concat_ws('/', slice(split(dir, '/'), 1, n)))"
_LINE = f"case when dir = '' then array('') else array_append({_ANCESTORS}, dir) end"


def directory_beliefs(said: DataFrame, block: int = BLOCK) -> DataFrame:
    """(index_prefix, dir, belief) of every directory of (index_prefix, dir, s0..s4), ancestors included."""
    zero = [F.lit(0.0).alias(c) for c in S]
    above = said.where("dir <> ''").select("index_prefix", F.explode(F.expr(_ANCESTORS)).alias("dir"), *zero)
    dirs = cut_lineage(said.select("index_prefix", "dir", *S).unionByName(above).groupBy("index_prefix", "dir").agg(*[F.sum(c).alias(c) for c in S]))
    large = dirs.groupBy("index_prefix").count().where(F.col("count") > block).select("index_prefix")
    if not large.take(1):
        return dirs.withColumn("block", F.lit("")).groupBy("index_prefix").applyInPandas(_block, _BELIEFS).select("index_prefix", "dir", "belief")
    below = (
        dirs.select("index_prefix", F.explode(F.expr(_LINE)).alias("dir"))
        .groupBy("index_prefix", "dir").count()
    )
    crown = cut_lineage(below.where(F.col("count") > block).select("index_prefix", "dir", F.lit(True).alias("crown")))
    # a directory's block is its highest ancestor, or itself, that is no part of the crown
    lines = dirs.select("*", F.posexplode(F.expr(_LINE)).alias("n", "line"))
    at = lines.join(crown.withColumnRenamed("dir", "line"), ["index_prefix", "line"], "left").where("crown is null")
    dirs = dirs.join(at.groupBy("index_prefix", "dir").agg(F.min_by("line", "n").alias("block")), ["index_prefix", "dir"], "left")
    blocks = dirs.where("block is not null")
    ups = cut_lineage(blocks.groupBy("index_prefix", "block").applyInPandas(_block, _BELIEFS).where("dir = block").select("index_prefix", "block", "up"))
    parent = F.expr("substring(block, 1, greatest(length(block) - length(substring_index(block, '/', -1)) - 1, 0))").alias("dir")
    told = ups.select("index_prefix", parent, *[F.col("up")[k].alias(c) for k, c in enumerate(S)]).groupBy("index_prefix", "dir").agg(*[F.sum(c).alias(c) for c in S])
    tops = dirs.where("block is null").select("index_prefix", "dir", *S).unionByName(told.join(crown, ["index_prefix", "dir"]).drop("crown"))
    tops = tops.groupBy("index_prefix", "dir").agg(*[F.sum(c).alias(c) for c in S]).withColumn("block", F.lit(""))
    high = cut_lineage(tops.groupBy("index_prefix").applyInPandas(_block, _BELIEFS).select("index_prefix", "dir", "belief"))
    down = ups.select("*", parent).join(high, ["index_prefix", "dir"]).select("index_prefix", "block", _down("belief", "up").alias("d"))
    down = down.select("index_prefix", F.lit(None).cast("string").alias("dir"), *[F.col("d")[c].alias(c) for c in S], "block")
    low = blocks.unionByName(down).groupBy("index_prefix", "block").applyInPandas(_block, _BELIEFS).select("index_prefix", "dir", "belief")
    return low.unionByName(high)


@F.pandas_udf(_FIVE)
def _down(belief: pd.Series, up: pd.Series) -> pd.DataFrame:
    return _five(to_child(_rows(belief) - _rows(up), DIR_GIVEN_DIR))


def labelled_files(files: DataFrame, config: DataFrame, block: int = BLOCK) -> DataFrame:
    """Every current file with its label, whether it lies in an ignored directory, and the label's log-odds against handwritten."""
    judged = files.where(F.col("file_path").isNotNull() & F.col("index_prefix").isNotNull()).select(
        "index_prefix", "file_path", "scanned_at", "sha256", _evidence("code", "file_path").alias("e")
    )
    ignored = config.select(F.explode("ignored_dirs").alias("d")).distinct().agg(F.collect_set("d").alias("ignored"))
    path = F.regexp_replace(F.regexp_replace("file_path", r"\\", "/"), r"^(\./)+|/+(?=/)", "")
    f = cut_lineage(
        newest(judged, "e").withColumn("parts", F.split(path, "/"))
        .withColumn("dirs", F.expr("slice(parts, 1, size(parts) - 1)"))
        .crossJoin(F.broadcast(ignored))  # one row: the fixed list of names
        .select(
            "index_prefix", "file_path", F.array_join("dirs", "/").alias("dir"), F.lower(F.regexp_extract("file_path", r"\.(\w+)$", 1)).alias("ext"),
            F.arrays_overlap("dirs", F.coalesce("ignored", F.array().cast("array<string>"))).alias("ignored"),
            F.col("e.body").alias("body"), F.col("e.phi").alias("phi"), F.col("e.size").alias("size"),
            F.exists("dirs", lambda d: d.isin(*VENDOR_DIRS) | d.rlike(r"^@?[A-Za-z][\w.]*-v?\d+\.\d+\.\d+")).alias("vendor_place"),
        )
    )
    # the same body in a vendored place or under a library's banner says that a copy is vendored wherever it lies, the more the longer it is;
    # files without a body take no part in the join
    full = f.where("body <> ''")
    libraries = full.groupBy("body").agg(F.max(F.col("vendor_place") | (F.col("phi")[3] > 4)).alias("library")).where("library")
    said = F.when(F.col("library") & (F.col("phi")[3] <= 4), 8.0 * (1 - F.exp(-F.col("size") / 80.0))).otherwise(0.0)
    with_copies = full.join(small(libraries), "body", "left").withColumn("phi", F.transform("phi", lambda x, k: F.when(k == 3, x + said).otherwise(x))).drop("library")
    f = cut_lineage(with_copies.unionByName(f.where("body = ''")).drop("body", "size", "vendor_place"))

    group = ["index_prefix", "dir", "ext"]
    groups = f.select(*group, _from_file("phi").alias("u")).groupBy(*group).agg(*[F.sum(f"u.{c}").alias(c) for c in S])
    groups = cut_lineage(groups)
    beliefs = directory_beliefs(groups.select("index_prefix", "dir", _from_group(*S).alias("u")).groupBy("index_prefix", "dir").agg(*[F.sum(f"u.{c}").alias(c) for c in S]), block)
    groups = groups.join(beliefs, ["index_prefix", "dir"]).select(*group, _group_belief(F.struct(*S), "belief").alias("belief"))
    j = f.join(small(cut_lineage(groups)), group).select("index_prefix", "file_path", "ignored", _labels("phi", "belief").alias("l"))
    return j.select("index_prefix", "file_path", F.when(F.col("ignored"), F.lit("ignored")).otherwise(F.col("l.label")).alias("label"), F.col("l.log_odds").alias("log_odds"))


def not_handwritten(files: DataFrame, config: DataFrame) -> DataFrame:
    """The current files that nobody wrote by hand for the project."""
    return labelled_files(files, config).where("label <> 'handwritten'")


def handwritten(files: DataFrame, config: DataFrame) -> DataFrame:
    """The current files that remain."""
    return labelled_files(files, config).where("label = 'handwritten'")

