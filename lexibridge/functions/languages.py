"""Languages of texts in Latin script by their frequent words and letters, as Column expressions; samples of files to tell it from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Frequent words and telling letters by which languages are told apart, in the order that decides ties.
SPANISH = "como con de del el en es la las los para por que un una y".split()
STOPWORDS = {
    "en-US": "a an and are as be by for from in is not of on or that the this to with".split(),
    "fr-FR": "avec ce cette dans de des du est et la le les pas plus pour que qui sur un une".split(),
    "de-DE": "auf das dem den der des die ein eine für im ist mit nicht und von zu".split(),
    "es-ES": SPANISH + "coche conducir móvil ordenador vosotros vuestro".split(),
    "es-419": SPANISH + "carro celular computadora manejar ustedes".split(),
    "pt-BR": "a as com da de do e em não o os para por que um uma".split(),
    "it-IT": "che con del della di e gli il in la le lo non per un una".split(),
    "vi-VN": "các cho của có không là một người như này trong và với được".split(),
}
LETTERS = {
    "vi-VN": "ăâđêôơưáàảãạấầẩẫậắằẳẵặéèẻẽẹếềểễệíìỉĩịóòỏõọốồổỗộớờởỡợúùủũụứừửữựýỳỷỹỵ",
    "fr-FR": "àâæçéèêëîïôœùûüÿ",
    "es-ES": "áéíóúñü¿¡",
    "es-419": "áéíóúñü¿¡",
    "pt-BR": "ãõáâàéêíóôúç",
    "de-DE": "äöüß",
    "it-IT": "àèéìíîòóùú",
}
TOKEN = "[A-Za-zÀ-ÖØ-öø-ÿ]+"
TOKENS, HINT, BASIC = 300, 3, 0.92
#: Code points that mostly hold more tokens than are asked for; where they do not, the whole text is cut.
HEAD = 4_096
#: The telling letters as a few ranges and more: long sets of single letters are slow to match.
_CODES = sorted({ord(x) for letters in LETTERS.values() for x in letters})
TELLING = "".join(rf"\x{{{min(block):X}}}-\x{{{max(block):X}}}" for block in ([c for c in _CODES if c >> 8 == b] for b in sorted({c >> 8 for c in _CODES})))


def _one_of(words: list[str]):
    return lambda x: x.isin(words)


def latin_language(c: Column | str) -> Column:
    """struct(language, score, confidence): the language of most hits, the first listed of equal ones; null below four tokens, without a hit
    (but English for eight tokens or more in basic letters), and for fewer than two hits in more than twelve tokens.

    Hits: frequent words among the first 300 tokens, three more for a telling letter anywhere.
    """
    text = F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))
    tokens = lambda t: F.regexp_extract_all(t, F.lit(f"({TOKEN})"), 1)
    without = lambda t, pattern: F.regexp_replace(t, pattern, "")
    # Most of most texts is ASCII: other letters are looked for in what is left without it. Counts are differences of lengths, so that no letter becomes a string.
    parts = F.struct(text.alias("text"), without(text, r"[\x00-\x7F]+").alias("beyond"), (F.length(text) - F.length(without(text, "[A-Za-z]+"))).alias("plain"), tokens(F.left(text, F.lit(HEAD))).alias("head"))

    def own(s: Column) -> Column:
        # One token more than asked for: the last one asked for is not cut short.
        first = F.when((F.size(s["head"]) > TOKENS) | (F.length(s["text"]) <= HEAD), s["head"]).otherwise(tokens(s["text"]))
        letters = s["plain"] + F.length(without(s["beyond"], r"[^\p{L}]+"))
        return F.struct(F.slice(first, 1, TOKENS).alias("tokens"), without(F.lower(s["beyond"]), f"[^{TELLING}]+").alias("told"), ((letters > 0) & (s["plain"] >= letters * BASIC)).alias("basic"))

    def words(s: Column) -> Column:
        frequent = F.filter(F.transform(s["tokens"], lambda t: F.lower(t)), _one_of(sorted({w for ws in STOPWORDS.values() for w in ws})))
        return F.struct(F.size(s["tokens"]).alias("tokens"), frequent.alias("low"), s["told"].alias("told"), s["basic"].alias("basic"))

    def rank(s: Column) -> Column:
        hits = {k: F.size(F.filter(s["low"], _one_of(ws))) + (F.when(s["told"].rlike(f"[{LETTERS[k]}]"), HINT).otherwise(0) if k in LETTERS else F.lit(0)) for k, ws in STOPWORDS.items()}
        ranked = F.array_sort(F.array(*[F.struct((-h).alias("less"), F.lit(i).alias("place"), F.lit(k).alias("language")) for i, (k, h) in enumerate(hits.items())]))
        return F.struct(s["tokens"].alias("tokens"), s["basic"].alias("basic"), ranked.alias("ranked"))

    def judge(s: Column) -> Column:
        n, best, second = s["tokens"], -s["ranked"][0]["less"], -s["ranked"][1]["less"]
        language = s["ranked"][0]["language"]
        sure = F.lit(0.5) + F.least(F.lit(0.3), best / n * 2.4) + (best - second) / best * 0.18 + F.when((language == "en-US") & s["basic"], 0.03).otherwise(0.0)
        out = lambda name, score, confidence: F.struct(name.alias("language"), score.alias("score"), confidence.alias("confidence"), n.alias("tokens"))
        none = out(F.lit(None).cast("string"), best, F.lit(0.0))
        return F.when(n < 4, none).when((best <= 0) & (n >= 8) & s["basic"], out(F.lit("en-US"), best, F.lit(0.52))).when((best <= 0) | ((best < 2) & (n > 12)), none).otherwise(out(language, best, F.round(F.least(F.lit(0.93), sure), 2)))

    # Arrays of one element, so that every step is worked out once.
    made = F.array(parts)
    for step in (own, words, rank, judge):
        made = F.transform(made, step)
    return made[0]


#: Code points of a file that its language is told from.
SAMPLE_LENGTH = 6_000


def language_samples(pieces: DataFrame, file: str, place: str, text: str, limit: int = SAMPLE_LENGTH) -> DataFrame:
    """(file, sample): the first `limit` code points of each file's pieces, white space made one blank, a blank between pieces.

    pieces: one row a piece, in the order of `place`. Running sums of lengths tell where a file's sample ends, so only pieces of
    the sample are ever put together. Blank and null pieces count for nothing; a file of nothing else has an empty sample.
    """
    plain = pieces.select(file, place, F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\s\x{A0}\x{3000}]+", " ")).alias("piece"))
    order = Window.partitionBy(file).orderBy(place)
    before = F.coalesce(F.sum(F.when(F.col("piece") != "", F.length("piece") + 1)).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    kept = plain.withColumn("before", before).where(F.col("before") < limit)
    part = F.when(F.col("piece") != "", F.struct(F.col(place).alias("place"), F.expr(f"substring(piece, 1, cast({limit} - before as int))").alias("piece")))
    return kept.groupBy(file).agg(F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda p: p.piece), " ").alias("sample"))
