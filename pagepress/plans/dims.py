"""Dimension tables: small, fixed, and spelt out as literals so that Catalyst folds or broadcasts them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Strategies, extensions, network profiles, codecs and the dictionary of the data formats served here.
STRATEGIES = ((0, "NONE"), (1, "WEBDICT"), (2, "LZ77"), (3, "LZW_IMAGE"), (4, "POOLING"), (5, "BROTLI"), (6, "HUFFMAN"))
EXTENSIONS = {
    5: (".html", ".htm", ".css", ".js", ".txt", ".xml", ".json", ".svg", ".md", ".php", ".jsp", ".asp", ".aspx"),
    4: (".jpg", ".jpeg", ".png", ".gif", ".webp", ".bmp"),
    2: (".woff", ".woff2", ".ttf", ".eot", ".otf", ".ico", ".bin"),
}
TYPE_OF_STRATEGY = {5: "WEB_TEXT", 4: "IMAGE", 2: "BINARY_FONT"}
RESOURCE_TYPES = ("WEB_TEXT", "IMAGE", "BINARY_FONT", "OTHER")
SAFE_EXTENSIONS = ("jpg", "jpeg", "png", "gif", "webp", "bmp", "ico", "svg")
FACTORY_IMAGE = ("jpg", "jpeg", "png", "gif", "webp", "bmp")
PROFILES = (
    ("5G", 500, 100, 10), ("4G", 50, 10, 50), ("3G", 5, 1, 200), ("WIFI_5GHZ", 300, 150, 5), ("WIFI_2_4GHZ", 100, 50, 10),
    ("ETHERNET", 1000, 1000, 1), ("FIBER", 500, 500, 1), ("DSL", 20, 5, 100), ("SATELLITE", 20, 2, 600),
)
CODECS = (
    ("HUFFMAN", "Huffman", 6, "variable-length codes by byte frequency"),
    ("LZ77", "LZ77", 2, "sliding-window matches"),
    ("BROTLI", "Brotli", 5, "raw deflate"),
    ("LZW_IMAGE", "LZWImage", 3, "zlib of RGB rows"),
    ("POOLING_IMAGE", "PoolingImage", 4, "mean pooling, then zlib of RGB rows"),
    ("WEBDICT", "WebDict", 1, "one-byte tokens for usual web strings"),
)
ARCHIVE_FALLBACK = 2
DICTIONARY = (
    "<html>", "</html>", "<head>", "</head>", "<body>", "</body>", "<div>", "</div>", "<span>", "</span>", "<p>", "</p>",
    "<a>", "</a>", "<ul>", "</ul>", "<li>", "</li>", "<table>", "</table>", "<tr>", "</tr>", "<td>", "</td>",
    "<form>", "</form>", "<script>", "</script>", "<style>", "</style>", "<link ", "<meta ",
    "<header>", "</header>", "<footer>", "</footer>", "<main>", "</main>", "<nav>", "</nav>", "<h1>", "</h1>", "<h2>", "</h2>",
    'class="', 'id="', 'style="', 'src="', 'href="', 'type="', 'name="', 'value="', 'title="', 'alt="',
    'charset="utf-8"', 'charset="', 'rel="', 'content="', 'placeholder="', "disabled",
    "display:flex;", "display:block;", "display:none;", "background-color:", "color:", "font-size:", "margin:", "padding:", "width:", "height:",
    "function ", "function()", "return ", "var ", "let ", "const ", "if (", "else {", "for (", "while (", "case ", "break;",
    "try {", "catch (", "async ", "await ", "null", "true", "false",
    "http://", "https://", "www.", "<!--", "-->", "text/html", "utf-8", "UTF-8", "text/css", "width=device-width", "initial-scale=1",
    " the ", " and ", " for ", " that ", " with ", " not ", " this ", " from ", " have ", " are ", " were ", " been ",
)
FIRST_TOKEN = 0x80


def strategies(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(STRATEGIES), "strategy_id int, strategy_name string")


def extensions(spark: SparkSession) -> DataFrame:
    rows = [(x, s, TYPE_OF_STRATEGY[s]) for s, xs in EXTENSIONS.items() for x in xs]
    return spark.createDataFrame([*rows, (".unknown", 5, "OTHER")], "ext string, strategy_id int, resource_type string")


def profiles(spark: SparkSession) -> DataFrame:
    rows = [(i, *p) for i, p in enumerate(PROFILES)]
    return spark.createDataFrame(rows, "ordinal int, profile string, download_mbps long, upload_mbps long, latency_ms int")


def codecs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(CODECS), "codec string, display_name string, strategy_id int, description string")


def dictionary(spark: SparkSession) -> DataFrame:
    """token, seed and the label of a token, like [0x80->...]."""
    rows = [(FIRST_TOKEN + i, s, f"[0x{FIRST_TOKEN + i:02X}->{s}]") for i, s in enumerate(DICTIONARY)]
    return spark.createDataFrame(rows, "token int, seed string, label string")


def sql_values(rows, columns: str) -> str:
    """A VALUES relation for DuckDB SQL."""
    lit = lambda v: "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)
    return "(VALUES " + ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows) + f") t({columns})"
