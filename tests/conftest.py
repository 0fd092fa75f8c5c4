import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tools"))

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from skyledger.session import local_session

    session = local_session("8")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF_DIR


@pytest.fixture(scope="session")
def gaz(spark):
    """A handful of places, in file order, and other names of some."""
    from skyledger.operators.geocode import Gazetteer
    from skyledger.sources.dims import normal_aliases

    places = [
        ("Delhi", "Delhi", 28.6, 77.2), ("Mumbai", "Maharashtra", 19.076, 72.8777), ("Bengaluru", "Karnataka", 13.0, 77.6), ("Hyderabad", "Telangana", 17.4, 78.5),
        ("Pune", "Maharashtra", 18.5, 73.9), ("Chennai", "Tamil Nadu", 13.1, 80.3), ("Patna", "Bihar", 25.6, 85.1), ("Darbhanga", "Bihar", 26.2, 85.9),
        ("Thiruvananthapuram", "Kerala", 8.5, 76.9), ("Kochi", "Kerala", 9.9, 76.3),
    ]
    others = [("Bangalore", "city", "Bengaluru"), ("दरभंगा", "city", "Darbhanga"), ("पटना", "city", "Patna"), ("बिहार", "state", "Bihar"), ("Orissa", "state", "Odisha")]
    rows = [(i, city, state, f"{city} District", lat, lon) for i, (city, state, lat, lon) in enumerate(places)]
    cities = spark.createDataFrame(rows, "ord int, city string, state string, district string, lat double, lon double")
    return Gazetteer(cities, normal_aliases(spark.createDataFrame([(i, *o) for i, o in enumerate(others)], "ord int, alias string, kind string, target string")))
