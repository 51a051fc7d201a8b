"""Fixed dictionaries: licences, quantisation codes and library names. Small, so they compile to column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Licences of well-known system libraries by lower-cased name.
LIBRARY_LICENSES = {
    "Apache-2.0": ["ssl", "crypto", "openssl", "mbedtls", "mbedcrypto", "mbedx509"],
    "Zlib": ["z", "zlib"],
    "curl": ["curl"],
    "LGPL-2.1-or-later": ["pthread", "dl", "rt", "m", "bpf", "libbpf", "glib-2.0", "glib", "lzma", "xz", "systemd", "sd-daemon"],
    "BSD-3-Clause": ["protobuf", "pcre", "pcre2", "uuid", "event", "event_core"],
    "GPL-2.0-or-later": ["elfutils", "elf", "dw"],
    "MIT": ["xml2", "libxml2", "expat", "ncurses", "curses", "tinfo", "ffi"],
    "blessing": ["sqlite3", "sqlite"],
    "bzip2-1.0.5": ["bz2"],
    "AFL-2.1": ["dbus-1"],
    "GPL-3.0-or-later": ["readline"],
}
# Spellings in package.xml.
ROS_LICENSES = {
    "Apache-2.0": ["Apache License 2.0", "Apache 2.0", "Apache License, Version 2.0"],
    "BSD-3-Clause": ["BSD"],
    "MIT": ["MIT"],
    "GPL-3.0-only": ["GPLv3", "GPL-3.0"],
    "GPL-2.0-only": ["GPLv2", "GPL-2.0"],
    "LGPL-3.0-only": ["LGPLv3", "LGPL-3.0"],
    "LGPL-2.1-only": ["LGPLv2", "LGPL-2.0", "LGPLv2.1", "LGPL-2.1"],
}
# SPDX ids of model licences; the key is the id in lower case, but for the GNU ones.
MODEL_LICENSES = ["Apache-2.0", "MIT", "BSD-2-Clause", "BSD-3-Clause", "MPL-2.0", "ISC", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0", "CC-BY-NC-SA-4.0", "CC-BY-NC-ND-4.0", "Artistic-2.0", "WTFPL", "Zlib", "Unlicense", "0BSD"]
GNU_LICENSES = ["GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0"]
KNOWN_SPDX = [*MODEL_LICENSES, *(f"{g}-only" for g in GNU_LICENSES), "BSL-1.0"]
# Quantisation names by code; codes that are not listed are unknown.
QUANTIZATIONS = {0: "F32", 1: "F16", 2: "Q4_0", 3: "Q4_1", 7: "Q8_0", 8: "Q8_1", 9: "Q2_K", 10: "Q3_K_S", 11: "Q3_K_M", 12: "Q3_K_L", 13: "Q4_K_S", 14: "Q4_K_M", 15: "Q5_K_S", 16: "Q5_K_M", 17: "Q6_K", 18: "IQ2_XXS", 19: "IQ2_XS", 20: "IQ3_XXS", 21: "IQ1_S", 22: "IQ4_NL", 23: "IQ3_S", 24: "IQ2_S", 25: "IQ4_XS", 26: "IQ1_M", 27: "BF16", 28: "Q4_0_4_4", 29: "Q4_0_4_8", 30: "Q4_0_8_8"}
# Quantisation marks in file names, longer ones first.
FILE_QUANTIZATIONS = ["Q4_0_8_8", "Q4_0_4_8", "Q4_0_4_4", "IQ2_XXS", "IQ3_XXS", "IQ2_XS", "IQ4_XS", "IQ4_NL", "IQ3_S", "IQ2_S", "IQ2_M", "IQ1_S", "Q3_K_XL", "Q4_K_XL", "Q5_K_XL", "Q6_K_XL", "Q8_K_XL", "Q2_K_XL", "Q3_K_S", "Q3_K_M", "Q3_K_L", "Q4_K_S", "Q4_K_M", "Q5_K_S", "Q5_K_M", "Q2_K", "Q6_K", "Q8_K", "Q4_0", "Q4_1", "Q8_0", "Q8_1", "BF16", "F32", "F16"]


def _mapped(value: Column, table: dict[str, list[str]], default: Column) -> Column:
    out = default
    for result, spellings in table.items():
        out = F.when(value.isin(spellings), result).otherwise(out)
    return out


def library_license(name: Column) -> Column:
    return _mapped(F.lower(name), LIBRARY_LICENSES, F.lit(None).cast("string"))


def ros_license(text: Column) -> Column:
    return _mapped(F.trim(text), ROS_LICENSES, F.trim(text))


def model_license(text: Column) -> Column:
    table = {x: [x.lower()] for x in MODEL_LICENSES} | {f"{g}-only": [g.lower()] for g in GNU_LICENSES}
    return _mapped(F.lower(text), table, text)


def is_known_spdx(text: Column) -> Column:
    return text.isin(KNOWN_SPDX)


def quantization(code: Column) -> Column:
    out = F.concat(F.lit("UNKNOWN("), code.cast("string"), F.lit(")"))
    for k, v in QUANTIZATIONS.items():
        out = F.when(code == k, v).otherwise(out)
    return out


def file_quantization(stem: Column) -> Column:
    up = F.upper(stem)
    return F.coalesce(*(F.when(up.contains(p), F.lit(p)) for p in FILE_QUANTIZATIONS))


def size_label_count(label: Column) -> Column:
    """'7B' -> 7000000000; null for other forms."""
    number = F.regexp_extract(F.upper(F.trim(label)), r"^([0-9]+(?:\.[0-9]+)?)[KMB]$", 1)
    unit = F.right(F.upper(F.trim(label)), F.lit(1))
    scale = F.when(unit == "K", 1e3).when(unit == "M", 1e6).when(unit == "B", 1e9)
    return F.when(number != "", F.round(number.try_cast("double") * scale).cast("long"))
