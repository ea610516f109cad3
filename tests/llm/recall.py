"""Share of labelled values that op10 finds, by kind: python tests/llm/recall.py.

Addresses and numbers are drawn at random and written in the usual forms. Names are lists that were not
used to choose those in pii.py: given names popular with newborns in the United States, 2023.
"""

import ipaddress
import random
import sys
from pathlib import Path

sys.path[:0] = [str(Path(__file__).resolve().parents[1]), str(Path(__file__).resolve().parents[2])]

NEWBORN = (
    "Liam Noah Oliver James Elijah Mateo Theodore Henry Lucas William Benjamin Levi Sebastian Jack Ezra Michael Daniel Leo Owen Samuel Hudson Alexander Asher Luca Ethan John David Jackson "
    "Joseph Mason Luke Matthew Julian Dylan Elias Jacob Maverick Gabriel Logan Aiden Thomas Isaac Miles Grayson Santiago Anthony Wyatt Carter Jayden Ezekiel Olivia Emma Charlotte Amelia "
    "Sophia Mia Isabella Ava Evelyn Luna Harper Sofia Camila Eleanor Elizabeth Violet Scarlett Emily Hazel Lily Gianna Aurora Penelope Aria Nora Chloe Ellie Mila Avery Layla Abigail Ella "
    "Isla Eliana Nova Madison Zoe Ivy Grace Lucy Willow Emilia Riley Naomi Victoria Stella Elena Hannah Valentina Maya Zoey Delilah"
).split()


def labelled(n: int = 1000) -> dict[str, list[str]]:
    draw = random.Random(7)
    digits = lambda k: "".join(draw.choice("0123456789") for _ in range(k))
    word = lambda k, letters="abcdefghijklmnopqrstuvwxyz": "".join(draw.choice(letters) for _ in range(k))

    def ipv6() -> str:
        groups = [draw.choice(["2001", "2a02", "fe80", "fd12"]), *(word(draw.randint(1, 4), "0123456789abcdef") for _ in range(7))]
        start, size = draw.randint(1, 7), draw.randint(0, 7)
        groups[start:start + size] = ["0"] * len(groups[start:start + size])
        return str(ipaddress.IPv6Address(":".join(groups)))

    many = lambda f: [f() for _ in range(n)]
    return {
        "email": many(lambda: f"{word(draw.randint(1, 12))}.{word(5)}@{word(8)}.{draw.choice(['com', 'co.uk', 'org'])}"),
        "secret": many(lambda: draw.choice(["password: " + word(9), "api_key=" + word(40), "AKIA" + word(16, "ABCDEFGHIJ234567"), "ghp_" + word(36), word(64, "0123456789abcdef")])),
        "ipv6": many(ipv6), "ipv4": many(lambda: str(ipaddress.IPv4Address(draw.getrandbits(32)))),
        "iban": many(lambda: draw.choice(["DE" + digits(20), "GB" + digits(2) + "NWBK" + digits(14), "FR" + digits(2) + " " + " ".join(digits(4) for _ in range(5)) + " " + digits(3)])),
        "phone": many(lambda: draw.choice([f"+1 {digits(3)} {digits(3)} {digits(4)}", f"+49 {digits(2)} {digits(4)} {digits(4)}", f"({digits(3)}) {digits(3)}-{digits(4)}", f"{digits(3)}-{digits(3)}-{digits(4)}"])),
        "ssn": many(lambda: f"{digits(3)}-{digits(2)}-{digits(4)}"), "card": many(lambda: draw.choice(["4" + digits(15), " ".join(["5" + digits(3), digits(4), digits(4), digits(4)])])),
        "name with a title": [f"{t} {g} Weber" for t in ("Mr", "Ms", "Dr.", "Prof.", "Sir") for g in NEWBORN], "name without a title": [f"{g} Weber" for g in NEWBORN],
    }


def measured(spark) -> dict[str, tuple[int, int]]:
    """(found as a whole and as this kind, all) of every kind."""
    from pyspark.sql import functions as F

    from dnsflow.llm import pii

    rows = [(k, v, f"so {v} it is") for k, vs in labelled().items() for v in vs]
    found = spark.createDataFrame(rows, "k string, v string, text string").withColumn("m", F.element_at(F.concat(pii._found(F.col("text")), F.array(F.lit(""))), 1))
    hit = (F.col("m") == F.col("v")) & (pii.kind_of(F.col("m")) == F.element_at(F.split("k", " "), 1))
    return {r.k: (r.hits, r.n) for r in found.groupBy("k").agg(F.sum(hit.cast("int")).alias("hits"), F.count("*").alias("n")).collect()}


if __name__ == "__main__":
    from session import make_session

    for kind, (hits, n) in sorted(measured(make_session()).items()):
        print(f"{kind}: {hits} of {n}")
