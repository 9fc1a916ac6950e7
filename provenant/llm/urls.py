"""URL filters (8), native: host and path rules, and logistic regression on hashed character n-grams for the rest.

The host of a url is what stands between the first ``://`` and the next ``/``, ``?``, ``#`` or end, A-Z lower-cased; its
path goes on to ``?``, ``#`` or end. A rule names a host and the start of a path; it fits that host and all its
subdomains, and of several that fit the longest decides (of equally long ones a block). Other urls are scored: n-grams of
the host (with both ends marked) and of the path are hashed into ``size`` buckets, each part's counts are divided by
the square root of their number, and a url whose probability reaches the threshold is blocked.

The model is trained from a small labelled table (at most ``most_labelled`` rows, else refused): Spark computes the same
features there, and the driver fits ``size + 1`` weights by gradient steps with ridge penalty. The threshold comes from held-out
scores: the urls are dealt by a hash of their host into ``folds`` folds, each scored by a model of the others; of the
thresholds with at least ``precision`` the one that finds most unwanted urls is taken, in the middle of the gap below it. The
weights enter the scan as one literal array, so judging is a projection without join or shuffle.

Defined results: a null url or one without ``://`` has empty host and path and fits no rule; without features the model has
no say, and it is allowed with the score of the bias; repeated rows are judged alike; other columns are not looked at; with
an empty labelled table all scores are 0.5 and nothing is blocked; an empty table has no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Params:
    grams: tuple[int, ...] = (3, 4)
    size: int = 4096
    precision: float = 0.95
    folds: int = 5
    most_labelled: int = 20_000
    steps: int = 400
    rate: float = 2.0
    ridge: float = 1e-3


#: The rules of the query: verdict and host/path.
RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]

#: The small labelled table: made-up addresses of both kinds, none a variant of another.
UNWANTED = """
http://www.royal-casino.example/slots/fruit-machine
https://casino-paradise.example/en/bonus-code.html
http://play-casino-now.example/12
https://m.goldcasino.example/de/free-spins
http://onlinepoker-club.example/tables/texas-holdem
https://poker-win.example/fr/jackpot/77
http://bet-on-sports.example/odds/today?ref=1
https://www.sure-bets.example/en/204
http://bestbets.example/tips
https://betting-king.example/es/live/9.html
http://lucky-bingo.example/free-tickets
https://jackpot-city.example/win-big
https://www.win-money.example/en/48
http://big-win-lottery.example/claim
https://roulette-tricks.example/secret-system
http://free-slots.example/de/31
https://slotmachines.example/play/free
http://blackjack-online.example/en/5
https://gamble-now.example/signup-bonus
http://bonus-bets.example/fr/81#top
https://adult-chat.example/cams/live
http://www.adult-movies.example/en/17
https://hot-adult-fun.example/free/3.html
http://sexy-girls.example/photos
https://free-sex-clips.example/de/88
http://xxx-tube.example/watch/902
https://xxxvideos-hd.example/top
http://best-porn.example/categories
https://pornstars.example/en/66
http://teen-cams.example/live/room7
https://nude-pics.example/gallery/2
http://escort-city.example/fr/vip
https://www.escorts-tonight.example/book
http://x-rated-club.example/enter
https://erotic-stories.example/es/41
http://milf-dating.example/join-free
https://hookup-tonight.example/girls-near-you
http://strip-show.example/webcam
https://fetish-world.example/en/100
http://dirty-dating.example/chat
http://cheap-viagra.example/order/no-prescription
https://viagra-online.example/en/11
http://buy-pills.example/de/cialis
https://www.diet-pills.example/lose-weight-fast
http://pills-discount.example/xanax
https://generic-meds.example/buy-cheap
http://pharmacy-no-rx.example/fr/tramadol
https://steroid-shop.example/order
http://miracle-cure.example/buy-now
https://weight-loss-trick.example/one-weird-tip
http://male-enhance.example/free-trial
https://cbd-cheap.example/es/92
http://warez-world.example/download/full-crack
https://crack-serial.example/keygen
http://free-keygen.example/en/windows-activator
https://www.torrent-hub.example/movies/free-download
http://best-torrents.example/fr/top100
https://nulled-scripts.example/premium-free
http://apk-hack.example/mod/unlimited-coins
https://cheat-codes-hack.example/de/generator
http://pirate-movies.example/watch-free-hd
https://free-mp3-download.example/en/63
http://hacked-accounts.example/list
https://carding-shop.example/cvv
http://replica-watches.example/rolex-cheap
https://replica-bags.example/en/44
http://fake-id.example/order-now
https://www.cheap-rolex.example/sale
http://designer-outlet-90off.example/buy
https://outlet-cheap-shoes.example/fr/discount
http://buy-followers.example/instagram-likes
https://buy-backlinks.example/seo-cheap
http://payday-loan.example/apply-now
https://instant-loans.example/no-credit-check
http://quick-cash.example/en/29
https://make-money-fast.example/work-from-home
http://earn-cash-online.example/de/secret
https://free-bitcoin.example/double-your-coins
http://crypto-giveaway.example/claim-prize
https://forex-profit.example/es/robot
http://get-rich.example/now
https://binary-option-win.example/signup
http://free-iphone.example/winner
https://prize-claim.example/you-won
http://gift-card-free.example/generator
https://survey-cash.example/fr/7
http://account-verify-login.example/secure/update-password
https://secure-bank-login.example/confirm
http://paypa1-verify.example/signin
https://essay-writers-cheap.example/order
http://click-here-free.example/offer/55
https://hot-deals-free.example/en/win
http://spam-links.example/buy/cheap/free
https://xx-live-sex.example/cams
http://adultfriend-x.example/en/196
https://bets-free.example/de/216.html
"""
WANTED = """
https://www.city-library.example/catalogue/history
http://library.university.example/en/opening-hours
https://museum-of-art.example/exhibitions/2019
http://natural-museum.example/fr/dinosaurs
https://www.daily-news.example/en/204
http://morning-herald.example/politics/article-77.html
https://evening-post.example/de/sport/31
http://news.regional.example/weather/storm
https://radio-four.example/programmes/history
http://public-radio.example/es/9.html
https://www.university.example/physics/staff
http://faculty.college.example/biology/lecture-3
https://school-district.example/calendar
http://primary-school.example/en/17
https://science-journal.example/volume/12/issue/3
http://journal-of-botany.example/abstract/88
https://astronomy.example/en/planets/saturn
http://chemistry-notes.example/fr/81#top
https://math-problems.example/algebra/12
http://open-textbook.example/chapter/5
https://wiki.example/Rivers_of_Europe
http://encyclopedia.example/de/eisenbahn
https://dictionary.example/en/word/house
http://translate-words.example/es/41
https://docs.software.example/manual/install
http://developer-docs.example/api/reference
https://kernel-notes.example/en/48
http://python-tutorial.example/lists.html
https://code-review.example/questions/5531
http://forum.gardeners.example/thread/roses
https://garden-diary.example/2018/spring
http://birdwatch.example/en/63
https://www.wild-flowers.example/fr/meadow
http://hiking-trails.example/alps/route-7
https://mountain-hut.example/de/88
http://national-park.example/visitors
https://weather-service.example/forecast/north
http://ocean-tides.example/en/100
https://climate-data.example/stations
http://geology.example/es/volcano
https://home-cooking.example/recipes/bread
http://soup-recipes.example/en/lentil
https://www.baking.example/fr/7
http://vegetable-kitchen.example/de/carrot-salad
https://family-travel.example/lisbon/day-two
http://train-journeys.example/en/29
https://old-town-hotel.example/rooms
http://city-council.example/minutes/2020
https://www.government.example/forms/passport
http://tax-office.example/en/11
https://health-service.example/advice/fever
http://hospital.example/fr/departments
https://dentist-practice.example/contact
http://law-review.example/de/92
https://court-reports.example/case/1998
http://parliament.example/es/debates
https://charity.example/about
http://volunteers.example/en/66
https://football-club.example/fixtures
http://chess-federation.example/games/44
https://swimming.example/fr/results
http://tennis-open.example/draws
https://cinema-times.example/en/5
http://theatre.example/de/tickets
https://orchestra.example/season
http://piano-lessons.example/beginners
https://folk-songs.example/es/92
http://poetry-archive.example/poem/autumn
https://bookshop.example/en/novels
http://publisher.example/authors/letters
https://painting-class.example/fr/watercolour
http://photo-club.example/landscapes
https://architecture.example/bridges
http://engineering.example/de/216.html
https://electronics-repair.example/radio
http://bicycle-workshop.example/en/brakes
https://car-manual.example/engine/oil
http://railway-history.example/steam
https://shipping-lines.example/es/ports
http://airport.example/departures
https://my-quiet-life.example/2017/05/a-walk
http://anna-writes.example/en/14
https://blog.teachers.example/fr/reading
http://blog.carpenter.example/oak-table
https://notes.example/thursday
http://the-kettle.example/de/tea
https://parents.example/toddlers/sleep
http://neighbourhood.example/meeting
https://farm-market.example/en/apples
http://bee-keeping.example/hive
https://dog-training.example/es/sit
http://cat-shelter.example/adopt
https://bank.example/branches
http://insurance.example/en/claims-help
https://post-office.example/parcels
http://jobs-board.example/fr/nurse
"""


def labelled_urls(spark: SparkSession) -> DataFrame:
    """(url, label): 1 for unwanted."""
    rows = [(url, label) for label, urls in ((1, UNWANTED), (0, WANTED)) for url in urls.split()]
    return spark.createDataFrame(rows, "url string, label int")


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The deciding rule's text and verdict, both null where none fits."""
    ordered = sorted(rules, key=lambda r: (-len(r[1]), r[0] != "block", r[1]))
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, text in reversed(ordered):
        own, slash, rest = text.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(slash + rest)
        name, verdict = F.when(fits, F.lit(text)).otherwise(name), F.when(fits, F.lit(what)).otherwise(verdict)
    return name, verdict


def _grams(part: Column, mark: str, params: Params) -> Column:
    """The buckets of a part's n-grams."""
    def of(n: int) -> Column:
        at = lambda i: F.pmod(F.xxhash64(F.lit(mark), F.substring(part, i, F.lit(n))), F.lit(params.size)).cast("int")
        return F.when(F.length(part) >= n, F.transform(F.sequence(F.lit(1), F.length(part) - (n - 1)), at)).otherwise(F.array().cast("array<int>"))

    return F.concat(*[of(n) for n in params.grams])


def _parts(host: Column, path: Column, params: Params) -> list[Column]:
    marked = F.when(host == "", F.lit("")).otherwise(F.concat(F.lit("^"), host, F.lit("$")))
    return [_grams(marked, "h", params), _grams(path, "p", params)]


@dataclass(frozen=True)
class Model:
    """Weights (the last is the bias), the threshold, and precision and recall of held-out urls at it."""

    weights: list[float]
    threshold: float
    precision: float
    recall: float


def _fit(x: np.ndarray, y: np.ndarray, params: Params) -> np.ndarray:
    """Gradient steps with ridge penalty on all but the bias. With fewer urls than buckets the steps are taken in the span of
    the urls' features, which holds all of them, so that a step costs a square of the number of urls."""
    n, few = len(y), len(y) <= params.size
    grams = x[:, :-1]
    inner = grams @ grams.T if few else None
    w, bias = np.zeros(n if few else params.size), 0.0
    for _ in range(params.steps if n else 0):
        z = (inner if few else grams) @ w + bias
        error = (1 / (1 + np.exp(-z)) - y) / n
        w -= params.rate * ((error if few else grams.T @ error) + params.ridge * w)
        bias -= params.rate * error.sum()
    return np.append(grams.T @ w if few else w, bias)


def best_threshold(scores: np.ndarray, y: np.ndarray, precision: float) -> tuple[float, float, float]:
    """(threshold, precision, recall): of the thresholds with that precision, or else the greatest, the one of most recall."""
    if not (y == 1).any():
        return 1.0, 0.0, 0.0
    order = np.argsort(-scores, kind="stable")
    s, hits = scores[order], np.cumsum(y[order] == 1)
    ends = np.flatnonzero(np.append(s[1:] < s[:-1], True))  # equal scores fall on one side
    exact, found = hits[ends] / (ends + 1), hits[ends] / hits[-1]
    enough = exact >= min(precision, exact.max())
    k = int(np.flatnonzero(enough)[found[enough].argmax()])
    below = s[ends[k] + 1] if ends[k] + 1 < len(s) else 0.0
    return float((s[ends[k]] + below) / 2), float(exact[k]), float(found[k])


def train(labelled: DataFrame, params: Params = Params()) -> Model:
    """The model of all labelled urls, with the threshold that their held-out scores ask for."""
    rows = labelled.where("url is not null and label is not null").select(host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), F.col("label").cast("double").alias("label"))
    fold = F.pmod(F.xxhash64("host"), F.lit(params.folds)).alias("fold")
    rows = rows.select("host", "path", "label", fold, *[c.alias(n) for c, n in zip(_parts(F.col("host"), F.col("path"), params), "hp")]).limit(params.most_labelled + 1).collect()
    if len(rows) > params.most_labelled:
        raise ValueError(f"more than {params.most_labelled} labelled urls")
    rows = sorted(rows, key=lambda r: (r["host"], r["path"], r["label"]))
    x, y, folds = np.zeros((len(rows), params.size + 1)), np.array([r["label"] for r in rows]), np.array([r["fold"] for r in rows])
    for i, r in enumerate(rows):
        x[i, -1] = 1
        for part in (r["h"], r["p"]):
            np.add.at(x[i], part, 1 / max(1, len(part)) ** 0.5)
    held_out = np.zeros(len(rows))
    for k in range(params.folds):
        out = folds == k
        held_out[out] = 1 / (1 + np.exp(-x[out] @ _fit(x[~out], y[~out], params)))
    return Model(_fit(x, y, params).tolist(), *best_threshold(held_out, y, params.precision))


def score(host: Column, path: Column, weights: list[float], params: Params) -> Column:
    table_ = F.from_json(F.lit("[" + ",".join(map(repr, weights)) + "]"), "array<double>")  # folded to one literal
    z = F.lit(weights[-1])
    for part in _parts(host, path, params):
        total = F.aggregate(part, F.lit(0.0), lambda acc, k: acc + F.get(table_, k))
        z = z + F.when(F.size(part) > 0, total / F.sqrt(F.size(part))).otherwise(0.0)
    return 1 / (1 + F.exp(-z))


def judge(pages: DataFrame, rules: list[tuple[str, str]], labelled: DataFrame, params: Params = Params(), id_column: str = "page_id", url: str = "url") -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, score."""
    model = train(labelled, params)
    rows = pages.select(pages[id_column].alias("page_id"), host_of(pages[url]).alias("host"), path_of(pages[url]).alias("path"))
    rows = rows.withColumn("score", score(F.col("host"), F.col("path"), model.weights, params))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    some = (F.col("host") != "") | (F.col("path") != "")
    own = F.when(some & (F.col("score") >= model.threshold), F.lit("block")).otherwise(F.lit("allow"))
    return rows.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"), "score")


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages").select("page_id", "url"), RULES, labelled_urls(spark))


QUERIES = {"op8_url_filters": op8_url_filters}
SQL: dict[str, str] = {}
