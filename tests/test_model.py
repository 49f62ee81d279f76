import pytest

from sediment.model import Pipeline, read_pipelines, silver_name


def test_defaults():
    (p,) = read_pipelines({"pipelines": [{"bronze": "shop_raw.orders", "keys": ["id"]}], "bronze_namespaces": ["shop_raw"]})
    assert (p.write_mode, p.bucket_count, dict(p.casts), p.target) == ("merge-on-read", 16, {}, "shop.orders")
    assert read_pipelines({}) == [] and read_pipelines(None) == []


def test_explicit_settings():
    entry = {"bronze": "raw.t", "keys": ["a", "b"], "write_mode": "copy-on-write", "bucket_count": 4, "casts": {"x": "int"}, "silver": "s.t"}
    (p,) = read_pipelines({"pipelines": [entry]})
    assert (p.keys, p.bucket_count, p.casts, p.target) == (("a", "b"), 4, {"x": "int"}, "s.t")


@pytest.mark.parametrize(
    "entry", [{"bronze": "x_raw.t"}, {"keys": ["a"]}, {"bronze": "x_raw.t", "keys": []}, {"bronze": "x_raw.t", "keys": ["a"], "write_mode": "cow"}]
)
def test_invalid(entry):
    with pytest.raises(ValueError):
        read_pipelines({"pipelines": [entry]})


def test_names():
    assert silver_name("shop_raw.orders") == "shop.orders"
    with pytest.raises(ValueError, match="_raw"):
        silver_name("shop.orders")
    with pytest.raises(ValueError, match="namespace"):
        silver_name("orders")


def test_missing_key_column():
    with pytest.raises(ValueError, match="nope"):
        Pipeline("x_raw.t", ("nope",)).check_columns(["id"])
