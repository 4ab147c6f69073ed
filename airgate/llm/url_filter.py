"""URL filter: host and path rules first, else logistic regression on hashed character n-grams of host and path.

Native: features and scores are DataFrame expressions; the bucket numbers of a bounded labelled sample are fitted on the driver.
"""

from __future__ import annotations

import string

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 4096
GRAMS = (3, 4, 5)
#: Labelled rows that the model is fitted on at most, those with the lowest hashes; steps and strengths of the fit.
SAMPLE, STEPS, RATE, DECAY = 20_000, 400, 2.0, 0.002

#: (host, path, verdict); a rule fits its host and all subdomains where the url's path starts with the rule's.
RULES = (
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
)

#: The small labelled table used where the caller has none of its own: plain urls of either kind, without their scheme. No
#: host of it stands in the given pages.
BLOCKED = """
best-jackpot-bonus24.top/play/now  royal-poker-777.club/register  betting-odds-live.win/en/4411  slots4you.bid/free-spins  casino-nights.info/de/bonus
lotto-millions-winner.xyz/claim  claim-your-prize.site/iphone  m.lucky-wheel-88.com/spin  www.vegas-chips.online/deposit  online-roulette-tips.biz/en/902
cheap-viagra-meds.biz/order.php  pharmacy-no-rx.online/cart  buy-cialis-now.shop/en/1187  slim-keto-drops.life/special-offer  fast-weightloss-tea.club/buy
www.discount-pillstore.info/de/3321  anti-aging-miracle.store/trial  muscle-max-pro.top/lander3  herbal-cure-all.win/order  weight-gone-30days.xyz/go
ads.bannerflow7.net/click/99813  track.clkserve.net/r/0af93e7  pixel.trk-media.com/i/000183  adserver.popmax.xyz/banner_728x90.gif  cpc-traffic-hub.com/aff/5512
x77.popunder-cash.xyz/go.php  redirect.leadsrv4.net/out/88121  clicks.adx-network9.com/c/7716  stats.visit-counter55.info/px.gif  sync.rtb-bidder.top/match/441
best-backlinks-seo.info/pricing  buy-followers-fast.site/instagram  bulk-email-lists.biz/download  link-farm-directory.net/add-url  auto-blog-content.top/spin
get-likes-cheap.club/en/100  article-spinner-pro.xyz/free-trial  guest-post-rank1.online/order  pbn-links-4u.com/de/77  traffic-bots-24h.win/start
payday-loans-today.loan/apply  quick-cash-advance.top/now  bad-credit-ok.biz/en/6120  forex-signals-vip.club/join  crypto-doubler-x2.xyz/invest
bitcoin-profit-robot.site/register.php  earn-money-at-home.info/start  debt-relief-pros.online/quote  binary-options-win.bid/demo  airdrop-token-gift.top/claim
hot-singles-nearby.date/join  adult-cams-live.xyz/room/22  xxx-video-tube8.top/watch/6619  dating-milf-zone.club/signup  sexy-chat-rooms.win/en/23
free-porn-clips.site/v/88123  hookup-tonight.online/profile  escort-ads-city.biz/list/4  nude-photo-leaks.xyz/a/9  meet-local-girls.date/go
warez-full-download.xyz/setup.exe  crack-keygen-serial.top/office.rar  torrent-movies-hd.club/get/5519  free-antivirus-scan.win/alert  driver-update-tool.site/download.exe
flash-player-update.info/install.exe  mp3-songs-free.biz/dl/3319  cracked-apk-mods.online/app/771  rom-files-4all.top/zip/12  nulled-scripts.xyz/t/4471
replica-rolex-outlet.shop/sale  luxury-bags-90off.store/gucci  cheap-jerseys-china.top/nfl  ray-ban-sale-uk.online/de/15  nike-shoes-discount.win/p/881
secure-login-verify.info/account  paypa1-support-center.com/verify  bank-alert-update.online/signin.php  appleid-unlock-help.site/login  mail-quota-upgrade.top/webmail
www.casino-royal.mirror.com/en/5520.html  m.win-casino.pages.net/de/771/  poker-win.host.org/en/3391  blog.bets-free.mirror.net/fr/902  free-spins.pages.com/es/4410
m.cheap-meds.host.com/en/1193.html  www.pills-cheap.mirror.org/de/88/  diet-pills.pages.net/fr/2205  spam-tools.host.net/en/6671  www.link-farm.pages.org/es/318.html
ads-click.mirror.com/en/7719  m.track-ads.host.org/de/4402  ad-tracker.pages.com/en/15/  free-porn.host.net/fr/3310  blog.cash-loans.mirror.org/en/808.html
free-gift-cards-now.club/amazon  survey-rewards-usa.xyz/q1  win-a-new-car.site/enter  coupon-codes-99.win/deal/31  hot-deals-today.bid/en/7719
"""
ALLOWED = """
www.lakeside.gov/parks/opening-hours  library.northfield.edu/catalogue/search  wiki.commons.org/wiki/Photosynthesis  docs.numericlib.org/en/stable/tutorial.html  dailyherald.com/2023/05/12/council-approves-budget
blog.marthacooks.com/recipes/lentil-soup  museum.city.org/exhibitions/bronze-age  weather.gov/forecast/coast  mathworld.edu/topics/prime-numbers  www.gardeners.org/en/2210
historyreview.org/articles/roman-roads  m.cinema.com/en/5120  physics.university.edu/courses/mechanics  birdwatching.org/species/kingfisher  oldmaps.net/fr/881
transport.gov/timetables/rail  www.townhall.org/de/1440  school.district.edu/calendar  theatre.com/programme/autumn  hiking.org/trails/ridge-walk.html
community-garden.org/events  chess.com/openings/sicilian  poetry.org/en/77  language.edu/grammar/verbs  astronomy.org/observing/jupiter
opera.org/tickets  news.coastline.com/world/harbour-reopens  blog.woodworker.net/projects/oak-table  code.forge.org/project/issues/1184  guide.camping.org/sites/lakes
kitchen.com/en/3316/  www.bakery.net/de/914.html  fieldnotes.org/es/5520  villagechurch.org/about  river-trust.org/projects/salmon
sternwarte.net/de/7713  bibliothek.org/katalog  gemeinde.net/aktuelles/2022  wanderverein.org/touren/harz  zeitung.com/politik/artikel-4417.html
mairie.org/services/etat-civil  www.cuisine.net/fr/6630  bibliotheque.edu/fonds/manuscrits  randonnee.org/sentiers/jura  journal.com/fr/2021/03/vendanges
ayuntamiento.org/tramites  museo.net/es/3381  cocina.com/es/recetas/gazpacho  universidad.edu/facultad/letras  periodico.com/cultura/libros
orchestra.org/season/2024  swimming.net/en/1881  m.football.com/fixtures  tennis.org/rankings  cycling.com/en/races/4102
hospital.org/departments/cardiology  nursing.edu/programs  health.gov/topics/sleep  dentist.net/contact  vets.org/advice/cats
court.gov/opinions/2019/114  parliament.org/bills/energy  statistics.gov/tables/population  census.gov/data/2020  treaty.org/text/annex-2
ocean.edu/research/currents  glacier.org/data  climate.net/en/4419  forest.org/reports/2018  volcano.gov/activity/weekly
basalt.net/en/120  linden.com/de/3308/  harrow.org/fr/7102.html  blog.tarnen.net/en/2117  m.seldon.com/es/6120
www.orrin.net/en/8801  bellan.org/de/219  thornes.com/en/9014  marlow.net/fr/3370/  keston.org/en/1002.html
www.harbour.mirror.com/en/5521.html  m.meadow.pages.net/de/772/  granite.host.org/en/3392  blog.willow.mirror.net/fr/903  copper.pages.com/es/4411
m.thimble.host.com/en/1194.html  www.sorrel.mirror.org/de/89/  tinder-box.pages.net/fr/2206  corvan.host.net/en/6672  www.elder-tree.pages.org/es/319.html
rother.mirror.com/en/7720  m.stonhe.host.org/de/4403  tharen.pages.com/en/16/  lintou.host.net/fr/3311  blog.wessly.mirror.org/en/809.html
walking-routes.info/en/118  www.parish-council.info/minutes  hafen.info/de/5530  blog.old-bridges.info/en/77  moulin.info/fr/4180
radio.net/schedule  podcast.org/episodes/42  photography.com/gallery/alps  architecture.edu/styles/gothic  pottery.net/glazes
airport.com/arrivals  ferry.net/routes/islands  hotel.org/rooms  railway-museum.org/visit  zoo.org/animals/otters
"""


def labelled_urls() -> list[tuple[str, int]]:
    """(url, 1 for block or 0 for allow)."""
    return [(f"http://{u}", y) for y, urls in ((1, BLOCKED), (0, ALLOWED)) for u in urls.split()]


def host_of(url: Column) -> Column:
    """Between the first `://` and `/`, `?`, `#` or the end, A-Z lower-cased; empty without `://` and for null."""
    found = F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit(""))
    return F.translate(found, string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    """What follows the host up to `?`, `#` or the end."""
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null without one."""
    name = verdict = F.lit(None).cast("string")
    for on, start, says in sorted(rules, key=lambda r: len(r[0]) + len(r[1])):
        fits = ((host == on) | host.endswith(f".{on}")) & path.startswith(start)
        name, verdict = F.when(fits, on + start).otherwise(name), F.when(fits, says).otherwise(verdict)
    return name, verdict


def buckets(host: Column, path: Column) -> Column:
    """Bucket numbers, from 1, of the character n-grams of `^host path$`, as it stands and as its shape.

    The shape has one `a` for each stretch of letters and one `0` for each of digits, so hyphens, digits, depth and endings
    count whatever the words are.
    """
    whole = F.lower(F.concat(F.lit("^"), host, F.lit(" "), path, F.lit("$")))
    shape = F.concat(F.lit("*"), F.regexp_replace(F.regexp_replace(whole, "[a-z]+", "a"), "[0-9]+", "0"))
    # Characters are cut apart once, so that long urls cost no more a character than short ones.
    return F.concat(*[_grams(F.split(x, ""), n) for x in (whole, shape) for n in GRAMS])


def _grams(signs: Column, n: int) -> Column:
    """Shifted copies of the characters laid side by side; the last n - 1 places, which reach beyond the end, are cut off."""
    size = F.size(signs)
    shifted = [F.slice(signs, k + 1, F.greatest(size - (n - 1), F.lit(0))).alias(f"c{k}") for k in range(n)]
    return F.transform(F.arrays_zip(*shifted), lambda g: (F.pmod(F.xxhash64(*[g[f"c{k}"] for k in range(n)]), F.lit(BUCKETS)) + 1).cast("int"))


def probability(found: Column, weights: list[float], bias: float) -> Column:
    """The model's probability of block; features are counts over the root of how many grams there are."""
    table = F.split(F.lit(",".join(repr(float(w)) for w in weights)), ",").cast("array<double>")
    total = F.aggregate(found, F.lit(0.0), lambda s, b: s + F.element_at(table, b))
    return 1.0 / (1.0 + F.exp(-(F.lit(float(bias)) + total / F.sqrt(F.greatest(F.size(found), F.lit(1)).cast("double")))))


def default_labels(spark: SparkSession) -> DataFrame:
    lines = F.split(F.lit("\n".join(f"{y} {u}" for u, y in labelled_urls())), "\n")
    held = spark.range(1, numPartitions=1).select(F.explode(lines).alias("line"))
    return held.select(F.substring("line", 3, 1000).alias("url"), F.substring("line", 1, 1).cast("int").alias("label"))


def train(labelled: DataFrame, sample: int = SAMPLE) -> tuple[list[float], float]:
    """Weights and bias by gradient descent over labelled (url, label), at most `sample` rows, those of the lowest hashes.

    Features are made by Spark; what the fit needs, the bucket numbers of the bounded sample, reaches the driver once. Both
    labels weigh alike, however many rows they have; rows without url or label are left out.
    """
    url = F.col("url")
    rows = labelled.where("url is not null and label is not null").select(F.col("label").cast("double").alias("label"), "url")
    rows = rows.withColumn("draw", F.xxhash64("url", "label")).orderBy("draw", "url", "label").limit(sample)
    held = rows.select("draw", "label", buckets(host_of(url), path_of(url)).alias("found")).collect()
    held.sort(key=lambda r: (r["draw"], r["found"], r["label"]))
    if not held:
        return [0.0] * BUCKETS, 0.0
    label = np.array([r["label"] for r in held])
    row = np.repeat(np.arange(len(held)), [len(r["found"]) for r in held])
    gram = np.concatenate([np.array(r["found"], np.int64) - 1 for r in held])
    scale = 1 / np.sqrt([max(1, len(r["found"])) for r in held])
    blocked = float((label > 0.5).sum())
    share = np.where(label > 0.5, 0.5 / max(1.0, blocked), 0.5 / max(1.0, len(held) - blocked))
    weights, bias = np.zeros(BUCKETS), 0.0
    for _ in range(STEPS):
        score = np.bincount(row, weights[gram], len(held)) * scale + bias
        off = (label - 1 / (1 + np.exp(-score))) * share
        weights = weights * (1 - DECAY) + RATE * np.bincount(gram, (off * scale)[row], BUCKETS)
        bias += RATE * off.sum()
    return weights.tolist(), float(bias)


def judge_urls(pages: DataFrame, labelled: DataFrame | None = None, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict and score (the model's probability of block) of every row.

    A url's longest fitting rule decides; without one the model does, blocking at 0.5. Null urls and urls without `://`
    have empty host and path and are judged by the model like others. Repeated rows are judged alike; other columns are
    ignored. An empty table gives no rows; with an empty labelled table every score is 0.5 and the verdict is block.
    """
    weights, bias = train(labelled if labelled is not None else default_labels(pages.sparkSession))
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule, says = rule_of(F.col("host"), F.col("path"), rules)
    scored = rows.withColumn("score", probability(buckets(F.col("host"), F.col("path")), weights, bias))
    verdict = F.coalesce(says, F.when(F.col("score") >= 0.5, "block").otherwise("allow"))
    return scored.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"), "score")
