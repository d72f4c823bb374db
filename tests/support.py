"""Constants and planted rows shared by the tests, apart from the fixtures (two conftest modules share one name)."""
import random

SF_SMALL = "/root/testdata/sf0.001"
SF_CHECK = "/root/testdata/sf0.01"

HEADER = "CustomerID,Gender,Age,Annual Income (k$),Spending Score (1-100)"
# Planted clusters: rows, income and score at their middle, in the order of the segment names below.
PLANTED = [("VIP Customers", 40, 88, 82), ("At-Risk / Churn", 30, 25, 20), ("New Customers", 35, 88, 17),
           ("Discount Seekers", 25, 25, 80), ("Loyal Customers", 70, 55, 50)]


def planted_rows(seed=1):
    """(id, gender, age, income, score) of 200 customers around five well-separated middles."""
    rng = random.Random(seed)
    rows = [(rng.choice(["Male", "Female"]), rng.randint(18, 70), x + rng.randint(-6, 6), y + rng.randint(-6, 6))
            for _, n, x, y in PLANTED for _ in range(n)]
    rng.shuffle(rows)
    return [(i + 1, *r) for i, r in enumerate(rows)]
