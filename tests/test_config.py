import pytest

from terrakiln import config as C

FILE = """
unit-scale = 0.5
[crop]
cellsize = 1
min-building-density = 2.0
[reconstruct]
lod12 = true
[[sources]]
name = "a"
quality = 1
[[sources]]
name = "b"
date_only = true
"""


def test_defaults():
    s = C.load()
    assert (s.crop.cellsize, s.crop.lod11_fallback_area, s.reconstruct.lod22, s.reconstruct.lod12) == (0.5, 69_000, True, False)


def test_file_words_and_units():
    s = C.load(FILE, ["--crop.cellsize=2", "--reconstruct.lod13", "--reconstruct.ground-strategy=user"])
    assert (s.crop.cellsize, s.reconstruct.lod12, s.reconstruct.lod13, s.reconstruct.ground_strategy) == (2.0, True, True, "user")
    assert [(x.name, x.date_only) for x in s.sources] == [("a", False), ("b", True)]
    u = C.scaled(s)
    assert (u.crop.cellsize, u.crop.lod11_fallback_area, u.crop.min_building_density) == (4.0, 276_000, 0.5)


@pytest.mark.parametrize(
    ("text", "words", "named"),
    [("[crop]\ncellsize = -1", [], "crop.cellsize"), ("[crop]\nnope = 1", [], "crop.nope"), ("[nope]\n", [], "nope"), ("[crop]\ncellsize = nan", [], "crop.cellsize"), ("[crop]\ncellsize = true", [], "crop.cellsize"),
     ("", ["--crop.max-nodata-fraction=2"], "crop.max-nodata-fraction"), ("", ["crop"], "crop"), ("", ["--reconstruct.ground-strategy=x"], "reconstruct.ground-strategy"), ("[[sources]]\nground_class = 300", [], "sources[0].ground_class"), ("unit-scale = 0", [], "unit-scale"), ("a = ", [], "TOML")],
)
def test_errors_name_the_field(text, words, named):
    with pytest.raises(C.ConfigError, match=named.replace("[", r"\[").replace("]", r"\]")):
        C.load(text, words)


def test_reference_lists_all():
    assert "| crop.cellsize | 0.5 | length |" in C.reference()
