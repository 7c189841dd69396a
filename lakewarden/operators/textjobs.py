"""Jobs over tables of texts."""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..functions import text as T


ROW_GROUP = 128 << 20  # bytes of a Parquet row group, which one task reads


def spread(df: DataFrame) -> DataFrame:
    """df dealt to all cores if it is so small that its files may hold fewer row groups than there are cores. Larger tables stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < cores * ROW_GROUP else df


AT_ONCE = 500  # texts whose matches are held until they are sent
FOUND = "rule_id string, family string, severity int, weight double, at int, excerpt string"


def _matches(rules: list[dict]):
    """Places of rules in texts. One automaton over all rules' gates reads each text once, in lower case, and names the rules that may
    match; only their patterns are run. Rules without a gate are run on all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        ungated = [i for i, r in enumerate(rules) if not r["gate"]]
        owners: dict[str, list[int]] = {}
        for i, r in enumerate(rules):
            for literal in r["gate"] or ():
                owners.setdefault(literal.lower(), []).append(i)
        gates = ahocorasick.Automaton()
        for literal, of in owners.items():
            gates.add_word(literal, of)
        if owners:
            gates.make_automaton()
        compiled: dict[int, re.Pattern] = {}  # a rule's pattern is compiled when it is first asked
        for batch in (b.slice(at, AT_ONCE) for b in batches for at in range(0, max(1, b.num_rows), AT_ONCE)):
            which, found = [], []
            for row, text in enumerate(batch.column(1)):
                text = text.as_py() or ""
                asked = set(ungated)
                if owners:
                    for _, of in gates.iter(text.lower()):
                        asked.update(of)
                for i in sorted(asked):
                    r = rules[i]
                    if i not in compiled:
                        compiled[i] = re.compile(r["pattern"], re.A)
                    skipped = max(0, len(text) - r["tail"]) if r["tail"] else 0
                    for m in compiled[i].finditer(text[skipped:] if skipped else text):
                        at = skipped + m.start()
                        which.append(row)
                        found.append((r["rule_id"], r["family"], r["severity"], r["weight"], at + 1, text[max(0, at - 20) : max(0, at - 20) + 200]))
            columns = list(zip(*found, strict=True)) or [()] * 6
            kinds = [pa.string(), pa.string(), pa.int32(), pa.float64(), pa.int32(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(which, pa.int64())), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], [batch.schema.names[0], "rule_id", "family", "severity", "weight", "at", "excerpt"])

    return run


def rule_scan(texts: DataFrame, id_col: str, text_col: str, rules: list[dict]) -> DataFrame:
    """One row for each text, rule and place that matches: rule_id, family, severity, weight, at (from 1), excerpt (200 characters from
    20 before the match).

    rules: as sources.rules reads them (rule_id, family, severity, weight, pattern, gate, tail). A gate lists literals of which each
    match holds one, in any case; a rule with a tail looks at the last so many characters only. Null texts are empty. Nothing is
    shuffled but small tables to all cores; thousands of rules cost one pass over a text and the patterns whose gate it meets."""
    source = spread(texts.select(id_col, text_col))
    return source.mapInArrow(_matches(rules), StructType([source.schema[id_col], *StructType.fromDDL(FOUND).fields]))


def risk_score(found: DataFrame, id_col: str, threshold: float = 0.5) -> DataFrame:
    """Weights of the distinct signals of each text, at most 1, and whether it is blocked."""
    score = F.least(F.lit(1.0), F.round(F.sum("weight"), 6))
    return found.select(id_col, "rule_id", "weight").distinct().groupBy(id_col).agg(score.alias("score")).withColumn("blocked", F.col("score") >= threshold)


def multi_engine_verdict(texts: DataFrame, found: DataFrame, id_col: str) -> DataFrame:
    """BLOCK, FLAG or ALLOW for every text from all findings."""
    agg = found.groupBy(id_col).agg(F.max("severity").alias("severity"), F.count_distinct("family").alias("engines"), F.array_join(F.sort_array(F.collect_set("family")), ",").alias("categories"))
    out = texts.select(id_col).join(agg, id_col, "left")
    verdict = F.when(F.col("severity") >= 3, "BLOCK").when(F.col("severity").isNotNull(), "FLAG").otherwise("ALLOW")
    return out.select(id_col, F.coalesce("severity", F.lit(0)).alias("severity"), F.coalesce("engines", F.lit(0)).alias("engines"), F.coalesce("categories", F.lit("")).alias("categories"), verdict.alias("verdict"))


def pii_report(texts: DataFrame, id_col: str, text_col: str, block: float = 0.95, flag: float = 0.8) -> DataFrame:
    """Hits by label of each text that has any, its most certain label and the action."""
    hits = texts.select(id_col, T.redaction_counts(F.col(text_col)).alias("hits")).select(id_col, F.explode("hits").alias("label", "n"))
    confidence = F.create_map(*[F.lit(x) for k, v in T.CONFIDENCE.items() for x in (k, v)])
    top = F.max(F.struct(F.element_at(confidence, F.col("label")).alias("c"), "label"))
    out = hits.groupBy(id_col).agg(F.sum("n").cast("long").alias("hits"), F.count("*").alias("labels"), top.alias("t"))
    action = F.when(F.col("t.c") >= block, "BLOCK").when(F.col("t.c") >= flag, "FLAG").otherwise("LOG")
    return out.select(id_col, "hits", "labels", F.col("t.label").alias("label"), F.col("t.c").alias("confidence"), action.alias("action"))


def pii_rollup(texts: DataFrame, by: str, text_col: str, block: float = 0.95, flag: float = 0.8) -> DataFrame:
    """Hits, texts and the action by source and label."""
    hits = texts.select(by, T.redaction_counts(F.col(text_col)).alias("hits")).select(by, F.explode("hits").alias("label", "n"))
    confidence = F.element_at(F.create_map(*[F.lit(x) for k, v in T.CONFIDENCE.items() for x in (k, v)]), F.col("label"))
    action = F.when(confidence >= block, "BLOCK").when(confidence >= flag, "FLAG").otherwise("LOG")
    return hits.groupBy(by, "label").agg(F.sum("n").cast("long").alias("hits"), F.count("*").alias("texts")).withColumn("action", action)


def worst_action(rollup: DataFrame, by: str) -> DataFrame:
    worst = F.max(F.when(F.col("action") == "BLOCK", 2).when(F.col("action") == "FLAG", 1).otherwise(0))
    return rollup.groupBy(by).agg(worst.alias("_w")).select(by, F.element_at(F.array(*map(F.lit, ("LOG", "FLAG", "BLOCK"))), F.col("_w") + 1).alias("action"))


def _fingerprints(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column(1):
                w = T.WORDS.findall((text.as_py() or "").lower())
                made = [" ".join(w[i : i + size]) for i in range(max(1, len(w) - size + 1))] if w else []
                words = np.frombuffer(b"".join([hashlib.md5(x.encode()).digest()[:8] for x in made]), "<u4").reshape(-1, 2).astype(np.uint64)
                bits = np.unpackbits(((words[:, 0] << np.uint64(32)) | words[:, 1]).astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
                out.append(int.from_bytes(np.packbits(2 * bits.sum(axis=0, dtype=np.int64) > len(made)).tobytes(), "big", signed=True))
            kept = [0, *range(2, batch.num_columns)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(out, pa.int64())], [*[batch.schema.names[c] for c in kept], "fingerprint"])

    return run


def simhash(texts: DataFrame, id_col: str, text_col: str, size: int = 4, keep: list[str] | None = None) -> DataFrame:
    """64-bit SimHash, with the id and the columns in `keep`: bit i is set iff more shingles have it set than not; 0 without words. Equal shingles count each.

    A shingle's 64 bits are the first two 32-bit words of its MD5, each read low byte first, the first one high. Votes are
    counted inside the row, in Arrow batches: nothing is shuffled but small tables to all cores."""
    source = spread(texts.select(id_col, text_col, *(keep or [])))
    return source.mapInArrow(_fingerprints(size), StructType([source.schema[id_col], *[source.schema[c] for c in keep or []], StructField("fingerprint", LongType())]))


def simhash_centroid(fingerprints: DataFrame, label: str) -> DataFrame:
    """Majority bit of each label's fingerprints; ties give 0."""
    votes = [F.sum(F.shiftrightunsigned("fingerprint", i).bitwiseAND(F.lit(1))).alias(f"_v{i}") for i in range(64)]
    bits = [F.when(F.col(f"_v{i}") * 2 > F.col("_n"), F.lit(-(1 << 63) if i == 63 else 1 << i)).otherwise(F.lit(0)) for i in range(64)]
    return fingerprints.groupBy(label).agg(F.count("*").alias("_n"), *votes).select(label, F.aggregate(F.array(*bits), F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b)).alias("centroid"))


def lsh_bands(fingerprints: DataFrame, bands: int = 8) -> DataFrame:
    """A row for each band of each fingerprint."""
    width = 64 // bands
    every = F.array(*[T.band(F.col("fingerprint"), i, width) for i in range(bands)])
    return fingerprints.select("*", F.posexplode(every).alias("band", "band_value"))


# Spans that may be secrets (hex and base64 runs, headers of private keys), as those who compare leak reports count them.
SPANS = (r"[a-fA-F0-9]{32,}", r"[a-zA-Z0-9+/]{32,}=*", r"-----BEGIN [A-Z ]+ PRIVATE KEY-----")


def window_bits(text: str, window: int, step: int) -> np.ndarray:
    """Bits per character of each window of a text (of the whole text if that is shorter), to six decimals."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    n = min(window, len(codes))
    if not n:
        return np.zeros(0)
    rows = np.sort(np.lib.stride_tricks.sliding_window_view(codes, n)[::step], axis=1)
    last = np.ones(rows.shape, bool)
    last[:, :-1] = rows[:, 1:] != rows[:, :-1]
    ends = np.flatnonzero(last)
    share = np.diff(np.concatenate(([-1], ends))) / n
    return np.round(np.bincount(ends // n, weights=-share * np.log2(share)), 6)


def _entropies(window: int, step: int, threshold: float):
    spans = [re.compile(p) for p in SPANS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits, at, found = [], [], []
            for text in batch.column(1):
                text = text.as_py() or ""
                each = window_bits(text, window, step)
                bits.append(float(each.max()) if len(each) else None)
                at.append(int(each.argmax()) * step + 1 if len(each) else None)
                found.append(sum(float(window_bits(m[0], len(m[0]), 1)[0]) > threshold for p in spans for m in p.finditer(text)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bits, pa.float64()), pa.array(at, pa.int32()), pa.array(found, pa.int32())], [batch.schema.names[0], "bits", "at", "spans"])

    return run


def text_entropy(texts: DataFrame, id_col: str, text_col: str, window: int = 32, step: int = 8, threshold: float = 4.5) -> DataFrame:
    """Bits per character of each text's most disordered window, where that begins (from 1), the spans that look like secrets and
    are as disordered, and whether either is beyond the threshold. Empty texts are left out. Counted inside the row."""
    source = spread(texts.select(id_col, text_col))
    schema = StructType([source.schema[id_col], *StructType.fromDDL("bits double, at int, spans int").fields])
    return source.mapInArrow(_entropies(window, step, threshold), schema).filter("bits is not null").withColumn("leak", (F.col("bits") > threshold) | (F.col("spans") > 0))


def card_scan(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Card numbers that pass the Luhn check, by brand and masked to the last four digits, and what else must not be stored:
    security codes and magnetic tracks, masked whole."""
    t = F.col(text_col)
    cards = F.transform(F.filter(T.card_candidates(t), lambda n: F.call_function("luhn_check", n)), lambda n: F.struct(T.card_brand(n).alias("brand"), F.concat(F.lit("****"), F.substring(n, -4, 4)).alias("masked")))
    other = lambda pattern, name: F.transform(F.regexp_extract_all(t, F.lit(T.ascii_bounds(pattern)), F.lit(0)), lambda _: F.struct(F.lit(name).alias("brand"), F.lit("****").alias("masked")))
    return texts.select(id_col, F.explode(F.concat(cards, other(T.CODE, "code"), other(T.TRACK, "track"))).alias("c")).select(id_col, "c.*")


def token_split_scan(texts: DataFrame, id_col: str, text_col: str, phrases: list[str], window: int = 5, tokenize=None) -> DataFrame:
    """Phrases hidden across token boundaries: (id, phrase, form) where a window of tokens contains a phrase that no single token of the text does. Windows are joined bare, with a space
    between tokens, and stripped of all but letters and digits (the phrase too); form is the first of these that shows it. Tokens: white space apart, in lower case, if `tokenize` does not
    say otherwise."""
    tokens = (tokenize or (lambda c: F.split(F.lower(c), r"\s+")))(F.col(text_col))
    t = texts.select(id_col, F.filter(tokens, lambda x: x != "").alias("_t")).filter(F.size("_t") > 1)
    windows = F.transform(F.sequence(F.lit(1), F.greatest(F.size("_t") - window + 1, F.lit(1))), lambda i: F.slice("_t", i, window))
    t = t.withColumn("_w", windows).withColumn("_bare", F.transform("_w", lambda w: F.array_join(w, ""))).withColumn("_spaced", F.transform("_w", lambda w: F.array_join(w, " ")))
    t = t.withColumn("_stripped", F.transform("_bare", lambda j: F.regexp_replace(j, "[^a-z0-9]", ""))).drop("_w")

    def shown(p):
        bare = F.regexp_replace(p, "[^a-z0-9]", "")
        hidden = ~F.exists("_t", lambda x: F.contains(x, p))
        form = F.when(F.exists("_bare", lambda j: F.contains(j, p)), "bare").when(F.exists("_spaced", lambda j: F.contains(j, p)), "spaced").when((bare != "") & F.exists("_stripped", lambda j: F.contains(j, bare)), "stripped")
        return F.struct(p.alias("phrase"), F.when(hidden, form).alias("form"))

    found = F.filter(F.transform(F.array(*[F.lit(p.lower()) for p in phrases]), shown), lambda x: x["form"].isNotNull())
    return t.select(id_col, F.explode(found).alias("f")).select(id_col, "f.phrase", "f.form")


def pseudonymize(texts: DataFrame, id_col: str, text_col: str, pattern: str, kind: str, key: str) -> tuple[DataFrame, DataFrame]:
    """Texts with every value of the pattern as a stable token [[KIND:hex10]], and the table of tokens (token, value)."""
    token = lambda v: F.concat(F.lit(f"[[{kind}:"), F.substring(F.sha2(F.concat(F.lit(key), v), 256), 1, 10), F.lit("]]"))
    values = F.regexp_extract_all(F.col(text_col), F.lit(pattern), F.lit(0))
    gaps = F.split(F.col(text_col), pattern, -1)
    rows = texts.select(id_col, values.alias("_v"), gaps.alias("_g"))
    out = F.array_join(F.zip_with("_g", F.transform("_v", token), lambda g, v: F.concat(g, F.coalesce(v, F.lit("")))), "")
    tokens = rows.select(F.explode("_v").alias("value")).distinct().select(token(F.col("value")).alias("token"), "value")
    return rows.select(id_col, out.alias("text")), tokens


def restore(texts: DataFrame, tokens: DataFrame, id_col: str, text_col: str, kind: str) -> DataFrame:
    """The texts with tokens put back, by a join on the table of tokens."""
    pattern = rf"\[\[{kind}:[0-9a-f]{{10}}\]\]"
    rows = texts.select(id_col, F.regexp_extract_all(F.col(text_col), F.lit(pattern), F.lit(0)).alias("_t"), F.split(F.col(text_col), pattern, -1).alias("_g"))
    values = rows.select(id_col, F.posexplode("_t").alias("_at", "token")).join(tokens, "token", "left").groupBy(id_col).agg(F.sort_array(F.collect_list(F.struct("_at", F.coalesce("value", "token").alias("v")))).alias("_v"))
    joined = rows.join(values, id_col, "left")
    return joined.select(id_col, F.array_join(F.zip_with("_g", F.coalesce("_v", F.array().cast("array<struct<_at:int,v:string>>")), lambda g, v: F.concat(g, F.coalesce(v["v"], F.lit("")))), "").alias("text"))


def uncited_claims(texts: DataFrame, id_col: str, text_col: str, claim: str, citation: str, around: int = 300, apart: int = 50) -> DataFrame:
    """Texts' claims without a citation within `around` characters: number of claims and of those uncited. A claim that begins within
    `apart` characters of one that counts is part of it."""
    hits, gaps = F.regexp_extract_all(F.col(text_col), F.lit(claim), F.lit(0)), F.split(F.col(text_col), claim, -1)
    t = texts.select(id_col, F.col(text_col).alias("_t"), hits.alias("_h"), gaps.alias("_g")).filter(F.size("_h") > 0)
    steps = F.zip_with(F.slice("_g", F.lit(1), F.size("_h")), F.col("_h"), lambda g, h: F.struct(F.char_length(g).alias("g"), F.char_length(h).alias("h")))
    start = F.struct(F.lit(0).alias("end"), F.array().cast("array<struct<at:int,to:int>>").alias("kept"))
    keep = lambda s, x: (F.size(s["kept"]) == 0) | (s["end"] + x["g"] - F.element_at(s["kept"], -1)["at"] >= apart)
    place = lambda s, x: F.struct((s["end"] + x["g"]).alias("at"), (s["end"] + x["g"] + x["h"]).alias("to"))
    t = t.withColumn("_k", F.aggregate(steps, start, lambda s, x: F.struct((s["end"] + x["g"] + x["h"]).alias("end"), F.when(keep(s, x), F.concat(s["kept"], F.array(place(s, x)))).otherwise(s["kept"]).alias("kept")))["kept"])
    near = lambda k: F.substring(F.col("_t"), F.greatest(k["at"] - around, F.lit(0)) + 1, k["to"] - F.greatest(k["at"] - around, F.lit(0)) + around)
    return t.select(id_col, F.size("_k").alias("claims"), F.size(F.filter("_k", lambda k: ~near(k).rlike(citation))).alias("uncited"))


def claim_rates(counted: DataFrame, by: str) -> DataFrame:
    """Claims, uncited ones and their share, by source."""
    return counted.groupBy(by).agg(F.sum("claims").alias("claims"), F.sum("uncited").alias("uncited")).withColumn("rate", F.round(F.col("uncited") / F.col("claims"), 6))


ASCII, WIDE = "".join(map(chr, range(0x21, 0x7F))), "".join(map(chr, range(0xFF01, 0xFF5F)))
#: Evasion transforms of a text, as expressions.
TRANSFORMS: dict[str, object] = {
    "identity": lambda c: c,
    "upper": F.upper,
    "lower": F.lower,
    "base64": lambda c: F.base64(F.encode(c, "UTF-8")),
    "underscore": lambda c: F.replace(c, F.lit(" "), F.lit("_")),
    "hyphen": lambda c: F.replace(c, F.lit(" "), F.lit("-")),
    "spaces": lambda c: F.replace(c, F.lit(" "), F.lit("   ")),
    "homoglyph": lambda c: F.translate(c, "oaei", "оаеі"),
    "zero_width": lambda c: F.replace(c, F.lit("i"), F.lit("i​")),
    "alternating": lambda c: F.array_join(F.transform(F.split(c, ""), lambda x, i: F.when(i % 2 == 0, F.lower(x)).otherwise(F.upper(x))), ""),
    "full_width": lambda c: F.translate(c, ASCII, WIDE),
}


def evasion_campaign(seeds: DataFrame, id_col: str, text_col: str, blocked) -> tuple[DataFrame, DataFrame]:
    """Block rate of each transform over the seeds, and the bypasses (transform, id). blocked: from a table (key, text) to the keys that a detector blocks."""
    made = F.array(*[F.struct(F.lit(k).alias("transform"), f(F.col(text_col)).alias("text")) for k, f in TRANSFORMS.items()])
    rows = seeds.select(id_col, F.explode(made).alias("x")).select(F.concat_ws("/", "x.transform", F.col(id_col).cast("string")).alias("key"), "x.transform", id_col, "x.text")
    hit = blocked(rows.select("key", "text")).select("key").distinct().withColumn("b", F.lit(True))
    judged = rows.select("key", "transform", id_col).join(hit, "key", "left").withColumn("b", F.coalesce("b", F.lit(False)))
    rates = judged.groupBy("transform").agg(F.count("*").alias("n"), F.count_if("b").alias("blocked"), F.avg(F.col("b").cast("int")).alias("block_rate"))
    return rates, judged.filter("not b").select("transform", id_col)


# Look-alike letters of Cyrillic and Greek, and digits used for letters.
HOMOGLYPHS = (
    "аеіорсухѕјһԁԛԝАВЕКМНОРСТХІЈЅУ"
    "αορνικυχΑΒΕΖΗΙΚΜΝΟΡΤΥΧ",
    "aeiopcyxsjhdqwABEKMHOPCTXIJSYaopvikuxABEZHIKMNOPTYX",
)
LEET = ("013457@$", "oleastas")
#: Control characters but white space, invisible ones, bidirectional marks, variation selectors and tag characters.
UNSEEN = r"[\x00-\x08\x0E-\x1F\x7F\x{AD}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{2064}\x{FE00}-\x{FE0F}\x{FEFF}\x{E0000}-\x{E007F}]"


@F.pandas_udf(StringType())
def compatible(text: pd.Series) -> pd.Series:
    """Unicode's compatibility composition (NFKC), which Spark has no function for."""
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def deobfuscate(text: Column) -> Column:
    """NFKC, look-alikes, invisible characters, digits for letters and spaced-out letters undone, lower case. ASCII texts are their own NFKC and don't go to Python."""
    composed = F.coalesce(compatible(F.when(F.octet_length(text) != F.char_length(text), text)), text)
    c = F.regexp_replace(F.translate(composed, *HOMOGLYPHS), UNSEEN, "")
    c = F.regexp_replace(F.lower(c), r"\b([a-z]) (?=[a-z]\b)", "$1")
    return F.trim(F.regexp_replace(F.translate(c, *LEET), r"\s+", " "))


ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "), ("&#x27;", "'"), ("&#47;", "/"), ("&amp;", "&"))


def decode_layers(texts: DataFrame, text_col: str, rounds: int = 5, shortest: int = 16, padding: bool = False) -> DataFrame:
    """Up to `rounds` rounds of character references, percent and base64 decoding of a text column; layers: the kinds of decoding that
    changed it, in their order. Base64 has `shortest` characters at least, its padding counted with them if `padding`. Each step is a projection of its own, so
    expressions don't multiply."""
    t = texts.withColumn("layers", F.array().cast("array<string>"))

    def step(t: DataFrame, name: str, decoded: Column) -> DataFrame:
        t = t.withColumn("_new", F.coalesce(decoded, F.col(text_col)))
        changed = F.col("_new") != F.col(text_col)
        return t.withColumn("layers", F.when(changed, F.concat("layers", F.array(F.lit(name)))).otherwise(F.col("layers"))).withColumn(text_col, F.col("_new")).drop("_new")

    for _ in range(rounds):
        plain = F.col(text_col)
        for ref, char in ENTITIES:
            plain = F.replace(plain, F.lit(ref), F.lit(char))
        t = step(t, "html", plain)
        t = step(t, "percent", F.when(F.col(text_col).rlike("%[0-9A-Fa-f]{2}"), F.try_url_decode(text_col)))
        coded = F.col(text_col).rlike(f"^[A-Za-z0-9+/]{{{shortest - 2 * padding},}}={{0,2}}$") & (F.char_length(text_col) % 4 == 0) & (F.char_length(text_col) >= shortest)
        t = t.withColumn("_raw", F.when(coded, F.try_to_binary(text_col, F.lit("base64")).cast("string")))
        printable = F.char_length(F.regexp_replace("_raw", r"[\x00-\x08\x0B-\x1F\x7F\x{FFFD}]", "")) >= 0.7 * F.char_length("_raw")
        t = step(t, "base64", F.when(printable, F.col("_raw"))).drop("_raw")
    return t
