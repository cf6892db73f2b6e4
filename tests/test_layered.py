import pytest

from lodeframe.sources.layered import Layer, current, missing, pull

LAYERS = [Layer("mines", 10, 3), Layer("holes", 10, 2), Layer("none", 10, 0)]


def feed():
    """Made here, so that workers get it by value."""

    def features(layer, page):
        return [{"OBJECTID": 10 * page + k, "name": f"{layer} {page} {k}"} for k in range(0 if (layer, page) == ("mines", 1) else 4)] + [{"OBJECTID": None}]

    return features


def test_a_killed_pull_goes_on(spark, tmp_path):
    path, flag, features = str(tmp_path / "x"), tmp_path / "killed", feed()

    def breaks(layer, page):
        if layer == "mines" and page == 2 and not flag.exists():
            flag.write_text("once")
            raise RuntimeError("killed between pages")
        return features(layer, page)

    with pytest.raises(Exception, match="killed"):
        pull(spark, LAYERS, breaks, path, batch=2)
    left = {(r.layer, r.page) for r in missing(spark, LAYERS, path).collect()}
    assert left == {("mines", 2)} or left == {("mines", 1), ("mines", 2)}
    assert {r.layer for r in current(spark, path).collect()} == {"holes"}  # mines isn't whole
    assert pull(spark, LAYERS, breaks, path, batch=2) == len(left)
    assert pull(spark, LAYERS, breaks, path) == 0
    got = [(r.layer, r.feature_id) for r in current(spark, path).collect()]
    want = [(x.name, str(f["OBJECTID"])) for x in LAYERS for p in range(x.pages) for f in features(x.name, p) if f["OBJECTID"] is not None]
    assert sorted(got) == sorted(want) and len(got) == len(set(got)) == 16


def test_only_edited_layers_are_pulled_again(spark, tmp_path):
    path, asked, features = str(tmp_path / "x"), tmp_path / "asked", feed()
    asked.mkdir()

    def seen(layer, page):
        (asked / f"{layer}-{page}").write_text("")
        return features(layer, page)

    pull(spark, LAYERS, seen, path)
    for f in asked.iterdir():
        f.unlink()
    assert pull(spark, [LAYERS[0], Layer("holes", 20, 1)], seen, path) == 1
    assert [f.name for f in asked.iterdir()] == ["holes-0"]
    rows = current(spark, path).collect()
    assert {(r.layer, r.edited) for r in rows} == {("mines", 10), ("holes", 20)}
    assert sum(r.layer == "holes" for r in rows) == 4
