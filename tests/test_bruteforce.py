"""Random dirty events against a plain Python evaluation, event by event."""

import datetime as dt
import hashlib
import random
from collections import defaultdict

from pyspark.sql.types import LongType, StructField, StructType

from upliftlens import schemas
from upliftlens.operators import clean, sessions
from upliftlens.plans import pipeline

PRICES = {"5": 5.0, "25": 25.0, "99.99": 99.99, "1500": 1500.0, "-3": 0.0, "abc": 0.0, "1d": 0.0, None: 0.0, "0": 0.0}
BRANDS = {"\tAcme ": "acme", "Zed": "zed", None: "unknown", " a b ": "a b"}
CATEGORIES = {"Home.Kitchen": "home", "toys": "toys", None: "unknown", "A.b.c": "a"}
KINDS = ["view", "view", "cart", "remove_from_cart", "purchase", "signup", None]
SCHEMA = StructType([*schemas.RAW_EVENTS.fields, StructField("position", LongType())])


def random_events(seed, n=400):
    rng = random.Random(seed)
    start = dt.datetime(2019, 12, 27, 22)
    out = []
    for i in range(n):
        time = None if rng.random() < 0.02 else start + dt.timedelta(hours=rng.randrange(120))
        user = None if rng.random() < 0.02 else rng.randrange(30)
        session = None if rng.random() < 0.02 else f"s{rng.randrange(50)}"
        out.append(
            (time, rng.choice(KINDS), i, rng.choice(list(CATEGORIES)), rng.choice(list(BRANDS)),
             rng.choice(list(PRICES)), user, session, i)
        )
    return out


def bucket(price):
    for low, high, label in ((0, 25, "<$25"), (25, 100, "$25-$100"), (100, 300, "$100-$300"),
                             (300, 1000, "$300-$1k"), (1000, float("inf"), "$1k+")):
        if low < price <= high:
            return label
    return "nan"


def expected_sessions(events):
    groups, per_user = defaultdict(list), defaultdict(set)
    for e in events:
        time, kind, _, _, _, _, user, session, position = e
        if None in (time, kind, user, session):
            continue
        groups[session, user].append((time, position, e))
        per_user[user].add(session)
    out = {}
    for (session, user), members in groups.items():
        time, _, first = min(members, key=lambda m: m[:2])
        kinds = [e[1] for _, _, e in members]
        prices = [PRICES[e[5]] for _, _, e in members]
        bought = kinds.count("purchase")
        gross = round(sum(p for p, k in zip(prices, kinds) if k == "purchase"), 6)
        total = len(per_user[user])
        out[session, user] = (
            session, user, kinds.count("view"), kinds.count("cart"), kinds.count("remove_from_cart"),
            bought, gross, max(prices), CATEGORIES[first[3]], BRANDS[first[4]], time.hour,
            int(time.weekday() >= 5), time.isocalendar().week, time, int(bought > 0),
            int(kinds.count("cart") > 0 and not bought), bucket(max(prices)), total,
            int(total == 1), "New" if total == 1 else "Returning",
        )
    return out


def expected_treatment(row):
    """(group, converted, gross, discount, net, triggered) of a session."""
    session, user, gross, price = row[0], row[1], row[6], row[7]
    weekend, converted, abandon, new = row[11], row[14], row[15], row[18]

    def digest(text):
        return hashlib.md5(text.encode()).hexdigest()

    group = "B" if int(digest(f"{user}_Coupon_Test_V1"), 16) % 100 >= 50 else "A"
    if group == "A":
        return group, converted, gross, 0.0, gross, 0
    chance = 0.08
    chance *= 2.0 if price < 25 else 1.5 if price < 100 else 1.0 if price < 300 else 0.5 if price < 1000 else 0.2
    chance *= (1.5 if new else 1) * (2.0 if abandon else 1) * (1.2 if weekend else 1)
    draw = int(digest(f"{session}_{user}_Coupon_Test_V1")[:13], 16) / 2**52
    triggered = int(not converted and draw < min(chance, 0.95))
    if triggered:
        converted, gross = 1, price
    cost = min(50.0, gross * 0.2) if converted and gross > 0 else 0.0
    return group, converted, gross, cost, max(gross - cost, 0.0), triggered


def test_sessions_and_treatment(spark):
    triggered = 0
    for seed in range(4):
        events = random_events(seed)
        raw = spark.createDataFrame(events, SCHEMA).repartition(3)
        built = sessions.build_sessions(clean.clean_events(raw), order_by=("position",))
        want = expected_sessions(events)
        assert {(r.user_session, r.user_id): tuple(r) for r in built.collect()} == want
        for r in pipeline.treat(built).collect():
            group, converted, gross, cost, net, hit = expected_treatment(want[r.user_session, r.user_id])
            assert (r.ab_group, r.converted, r.gross_revenue, r.coupon_triggered) == (group, converted, gross, hit)
            assert abs(r.discount_applied - cost) < 1e-9 and abs(r.net_revenue - net) < 1e-9
            triggered += hit
    assert triggered > 5
