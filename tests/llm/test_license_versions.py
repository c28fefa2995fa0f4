"""Every license family with each of its versions in plain words."""

import pytest

from marginalia.llm import licenses

FAMILIES = {"apache": ("apache license", "2.0"), "agpl": ("affero general public license", "3.0"), "lgpl": ("lesser general public license", "2.1"), "gpl": ("general public license", "3.0"), "fdl": ("free documentation license", "1.3"), "mpl": ("mozilla public license", "1.1"), "epl": ("eclipse public license", "2.0"), "cddl": ("common development and distribution license", "1.1"), "cpl": ("common public license", "1.0"), "eupl": ("european union public licence", "1.2"), "afl": ("academic free license", "2.1"), "osl": ("open software license", "2.1"), "artistic": ("artistic license", "2.0"), "bsl": ("boost software license", "1.0"), "zpl": ("zope public license", "2.1"), "psf": ("python software foundation license", "2.0"), "ofl": ("open font license", "1.1"), "odbl": ("open database license", "1.0"), "lppl": ("latex project public license", "1.3"), "cecill": ("cecill", "2.1"), "busl": ("business source license", "1.1"), "sspl": ("server side public license", "1.0")}


@pytest.mark.parametrize("stem", FAMILIES)
def test_version_labels(stem):
    name, version = FAMILIES[stem]
    for form in (" ", " v", " version "):
        found = [x[0] for x in licenses.scanner().scan(f"see {name}{form}{version.replace('.', ' ')} here")]
        assert f"{stem}-{version}" in found


def test_cecill_forms():
    scan = lambda text: [x[0] for x in licenses.scanner().scan(text)]
    assert scan("the cecill b text") == ["cecill"]
    assert scan("cecill free software license version 2 1") == ["cecill-2.1"]
