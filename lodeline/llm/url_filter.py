"""URL filter: rules on hosts and paths first, then a logistic regression on hashed character n-grams.

A rule ``host/path`` fits its host and every subdomain if the path starts with the rule's; the longest fitting rule
decides. URLs that no rule fits are judged by a model over character n-grams of the host and the path, trained on a small
labelled table of URLs and shipped as one array of BUCKETS weights. Everything per row is a built-in expression: no
shuffle, no Python. Training reads the labelled table alone, whatever the size of the input.

The labelled table is an input: any (host, path, label) rows, of at most TABLE_ROWS rows. ``labelled`` makes the default
one from the words below by stated rules: hosts of one word or two, with ordinary additions, under usual labels and
top-level domains, the same for either label, and ordinary hosts of names that mean nothing. It can be split by host, or by word so that no host of one part shares a
word with the other. A bad host is taken to be BLOCK_SHARE as frequent as a good one, so that a host the table says
nothing about is allowed; BLOCK_AT is the even chance.

Rules are a parameter and go into the plan as literals, so they are bounded: at most MAX_RULES.

Edge cases: a null url, or one without ``://``, has an empty host and path and, if no rule fits, is allowed: there is
nothing to judge; repeated rows are judged each; columns other than page_id and url pass by, whatever their names.
"""

from __future__ import annotations

import zlib

import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors  # noqa: F401  the vector type must be known to the session
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeline.llm.words import ascii_lower
from lodeline.storage import settle

RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
MAX_RULES = 2000
TABLE_ROWS = 100_000
BUCKETS = 1 << 18
SIZES = (3, 4, 5)
BLOCK_AT = 0.5
BLOCK_SHARE = 0.3
#: Of the fit: ridge and rounds.
REG, ROUNDS = 0.002, 60
#: Words of hosts that a crawl of prose leaves out, by what they offer, and words of ordinary hosts.
BAD_WORDS = (
    "casino casinos poker pokerstars roulette blackjack jackpot jackpots slots slotmachine bingo lotto lottery betting bets wager wagers sportsbet sportsbook bookmaker baccarat gambling gambler gamble "
    "viagra cialis levitra pills pillstore pharmacy pharma pharmameds meds onlinemeds tramadol xanax steroid steroids drugstore "
    "porn porno pornhub xxx xxxvideos sex sexy sexcam adult adults adultcam escort escorts nude nudes erotic erotica webcam camgirls hookup hookups fetish "
    "warez crack cracks cracked keygen keygens torrent torrents serials malware spyware phishing phish trojan exploit hacked "
    "ads adserver adserve adclick advert adverts adbanner banners tracker trackers tracking clicktracker popunder popads doubleclick clickbank affiliate affiliates pixeltrack retarget "
    "spam spammer spammers bulkmail payday paydayloan loan loans fastloans replica replicas cheapwatches getrich earncash freebie freebies giveaway prizes winner winners bonus bonuses linkfarm backlinks cheapest discount discounts"
).split()
GOOD_WORDS = (
    "news daily times herald tribune gazette journal review magazine press radio weather forecast politics world local city town village county region nature science physics biology chemistry history museum gallery archive library books reading "
    "stories poetry theatre cinema music concert orchestra guitar piano school college university academy teacher student lessons course education research institute laboratory hospital clinic doctor nursing family children parents garden flowers "
    "kitchen cooking recipes bakery coffee travel hotel railway airport harbour river mountain forest island beach camping walking cycling football tennis running swimming chess climbing sailing market street house building architecture design photo "
    "camera painting drawing craft pottery knitting sewing fashion software developer docs wiki manual support forum community project foundation charity church council government parliament justice police energy climate water farm farmers wildlife "
    "birds horses animals veterinary letters union workers trade industry steel engineering mechanics bicycle transport logistics shipping insurance bank economy business company office consulting language translation dictionary grammar philosophy "
    "zeitung nachrichten wetter stadt schule verein kirche garten kueche reisen bibliothek geschichte wissenschaft freunde musik theater bahnhof rathaus wohnung arbeit journal ville ecole musee cuisine voyage nature jardin lecture monde region "
    "the and that with this from they there their then than these those other another mother father brother together whether northern southern thing things nothing something morning evening station nation section election information edition tradition "
    "noticias ciudad escuela museo cocina viajes historia ciencia libros musica gobierno salud deporte mundo pueblo trabajo tierra"
).split()
ADDITIONS = "mega best top online my the world daily super go web net site zone hub first real new live club".split()
TOPS = "com net org info io de fr es co.uk com.au example.com example.org example.net".split()
ONSETS = "b br c ch cl d dr f fl g gr h j k l m n p pl pr r s sh sl sp st str t th tr v w wh".split()
VOWELS = "a e i o u ai ea ee ie io oa oo ou".split()
CODAS = ("", "", "", *"n r s t l m d nd ng nt st ck sh th ly".split())
NAMES = 1500
LABELS = ("", "www.", "m.", "blog.", "")
#: One host or word in so many is held out; rows for each word.
HELD_OUT, ROWS_PER_WORD = 4, 24


def labelled(part: str = "all", by: str = "host") -> list[tuple[str, str, float]]:
    """The default table: (host, path, 1.0 to block), all of it, or its part ``train`` or ``held-out`` by ``host`` or ``word``."""

    def drawn(*key: object) -> int:
        return zlib.crc32(repr(key).encode())

    def taken(word: str) -> bool:
        return part == "all" or (drawn(word) % HELD_OUT == 0) == (part == "held-out")

    rows = []
    for words, label in ((BAD_WORDS, 1.0), (GOOD_WORDS, 0.0)):
        # words with a common beginning stay together
        own = [w for w in dict.fromkeys(words) if by == "host" or taken(w[:4])]
        for word in own:
            for k in range(ROWS_PER_WORD):
                draw = drawn(word, k)
                mate, more = own[draw % len(own)], ADDITIONS[draw // 7 % len(ADDITIONS)]
                name = (word, f"{word}-{mate}", f"{more}-{word}", f"{more}{word}", f"{word}{more}", f"{word}-{more}")[k % 6]
                path = ("/", f"/{draw % 9000}", f"/{('en', 'de', 'fr', 'es')[draw % 4]}/{draw % 977}.html", f"/{own[draw // 11 % len(own)]}/{draw % 97}")[draw // 3 % 4]
                host = f"{name}.{TOPS[draw // 13 % len(TOPS)]}"
                if by == "word" or taken(host):
                    rows.append((LABELS[draw // 5 % len(LABELS)] + host, path, label))
    # names that mean nothing, of English sounds: what the table does not know is ordinary
    for k in range(NAMES):
        draw = drawn("name", k)
        parts = [ONSETS[x % len(ONSETS)] + VOWELS[x // 31 % len(VOWELS)] + CODAS[x // 311 % len(CODAS)] for x in (drawn(k, j) for j in range(2 + draw % 2))]
        host = f"{''.join(parts)}.{TOPS[draw // 13 % len(TOPS)]}"
        if part == "all" or (drawn(host) % HELD_OUT == 0) == (part == "held-out"):
            rows.append((LABELS[draw // 5 % len(LABELS)] + host, f"/{draw % 9000}", 0.0))
    return rows


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty without ``://`` or for null."""
    url = F.coalesce(url.cast("string"), F.lit(""))
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    after = F.substring(rest, F.length(host) + 1, F.length(rest))
    return ascii_lower(host), F.regexp_extract(after, r"^[^?#]*", 0)


def fitting_rule(host: Column, path: Column, rules: tuple[tuple[str, str], ...]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; both null if none does. Rules of one length go by their text."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"at most {MAX_RULES} rules")
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule, say in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        domain, _, tail = rule.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith("/" + tail)
        name, verdict = F.when(fits, rule).otherwise(name), F.when(fits, say).otherwise(verdict)
    return name, verdict


def grams(host: Column, path: Column) -> Column:
    """Character n-grams of every label of the host and every part of the path, marked with where they come from."""

    def of(parts: Column, mark: str) -> Column:
        def each(part: Column) -> Column:
            # by shifted arrays: a substring by its place would read the text from its start each time
            chars, shorter, found = F.split(F.concat(F.lit("^"), part, F.lit("$")), ""), None, []
            for n in range(1, SIZES[-1] + 1):
                after = F.slice(chars, n, F.greatest(F.lit(0), F.size(chars) - (n - 1)))
                shorter = chars if n == 1 else F.filter(F.zip_with(shorter, after, lambda a, b: F.concat(a, b)), lambda x: x.isNotNull())
                if n in SIZES:
                    found.append(F.transform(shorter, lambda x: F.concat(F.lit(mark), x)))
            return F.concat(*found)

        return F.flatten(F.transform(F.filter(parts, lambda x: x != ""), each))

    # the top-level domain, a usual first label before a domain and a path's numbers, language code and ending say nothing about the page
    name = F.regexp_replace(F.regexp_replace(host, r"^(www|m|blog)\.(?=[^.]+\.)", ""), r"(?<=.)\.[^.]*$", "")
    return F.concat(of(F.split(name, "\\."), "h"), of(F.split(F.regexp_replace(ascii_lower(path), "[0-9]+|\\.[a-z0-9]+$|(?<=/)[a-z]{2}(?=/|$)|/+$", ""), "/"), "p"))


def labelled_table(spark: SparkSession, part: str = "all", by: str = "host") -> DataFrame:
    """``labelled`` as a table of host, path and label.

    Its rows never stand in a plan: the driver would hold them as parsed expressions, and fold their n-grams there.
    """
    host, path, label = zip(*labelled(part, by), strict=True)
    rows = pa.table({"host": pa.array(host, pa.string()), "path": pa.array(path, pa.string()), "label": pa.array(label, pa.float64())})
    return settle(spark.createDataFrame(rows).coalesce(1), "urls")


def train(table: DataFrame) -> LogisticRegressionModel:
    """The model fitted on a labelled table of host, path and label (1 to block), the labels weighing by BLOCK_SHARE."""
    if table.limit(TABLE_ROWS + 1).count() > TABLE_ROWS:
        raise ValueError(f"a labelled table of at most {TABLE_ROWS} rows")
    rows = table.select(F.col("label").cast("double").alias("label"), grams(F.col("host"), F.col("path")).alias("grams")).coalesce(1)
    half = rows.agg(F.avg("label")).first()[0]
    rows = rows.withColumn("weight", F.when(F.col("label") > 0, BLOCK_SHARE / half).otherwise(1 / (1 - half)))
    hashed = HashingTF(numFeatures=BUCKETS, inputCol="grams", outputCol="features").transform(rows)
    return LogisticRegression(regParam=REG, maxIter=ROUNDS, featuresCol="features", labelCol="label", weightCol="weight").fit(hashed)


def judge(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, model: LogisticRegressionModel | None = None) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, score (the model's probability of block).

    ``model`` is one fitted before; without it the default table is fitted here.
    """
    model = model or train(labelled_table(pages.sparkSession))
    host, path = split_url(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    rows = HashingTF(numFeatures=BUCKETS, inputCol="grams", outputCol="features").transform(rows.withColumn("grams", grams(F.col("host"), F.col("path"))))
    rows = model.transform(rows).withColumn("score", vector_to_array("probability")[1])
    name, verdict = fitting_rule(F.col("host"), F.col("path"), rules)
    by_model = F.when((F.col("host") != "") & (F.col("score") >= BLOCK_AT), "block").otherwise("allow")
    return rows.select("page_id", "host", "path", name.alias("rule"), F.coalesce(verdict, by_model).alias("verdict"), F.round("score", 6).alias("score"))
