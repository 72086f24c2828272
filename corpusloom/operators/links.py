"""Links between files by the rare names they share: an inverted index with bounds on how many files hold a name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.functions import constants as C
from corpusloom.functions import paths as P
from corpusloom.operators.graph import checkpointed

# --- fixed values: names and lines ------------------------------------------------------------------------------
SCREAMING = r"\b[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)+\b"
CAMEL = r"\b[a-z][a-z0-9]*(?:[A-Z][a-z0-9]+)+\b"
#: The quote comes first, so that what must not stand before it is looked at only there.
QUOTED_KEY = r"""["'`](?<!class(?:Name)?(?:=| =|= | = |=\{).)([a-z][a-z0-9]*(?:_[a-z0-9]+)*)["'`]"""
COMMON_NAMES = (
    "useState useEffect useRef useMemo useCallback useContext useReducer useRouter useParams useSearchParams useLayoutEffect "
    "componentDidMount componentWillMount componentWillUnmount componentDidUpdate componentWillReceiveProps shouldComponentUpdate "
    "getDerivedStateFromProps mapStateToProps mapDispatchToProps setState forceUpdate defaultProps propTypes displayName "
    "preventDefault stopPropagation addEventListener removeEventListener getElementById querySelector querySelectorAll "
    "createElement appendChild innerHTML textContent className htmlFor tabIndex autoFocus readOnly defaultValue onClick "
    "onChange onSubmit onBlur onFocus onKeyDown dangerouslySetInnerHTML toString toLowerCase toUpperCase forEach indexOf "
    "localStorage sessionStorage setTimeout clearTimeout setInterval clearInterval requestAnimationFrame getItem setItem removeItem "
    "parseInt parseFloat isArray hasOwnProperty startsWith endsWith padStart toFixed getTime toISOString fromEntries "
    "createContext createStore applyMiddleware combineReducers getState createSlice configureStore createAsyncThunk "
    "useSelector useDispatch useNavigate useLocation async await isNaN encodeURIComponent decodeURIComponent"
).split()
COMMON_KEYS = (
    "client server strict utf8 text button submit div span none auto true false null get post put patch delete "
    "application json form input string number object function default index error errors data name title value "
    "type key click change react next node path image email password username"
).split()
EXPORTS = r"export\s+(?:default\s+)?(?:async\s+)?(?:function\*?|class|const|let|var|type|interface|enum)\s+([A-Za-z_$][\w$]*)"
EXPORT_LIST = r"export\s*\{([^}]{1,400})\}"
DEFINITIONS = [r"(?m)^(?:async\s+)?def\s+([A-Za-z_]\w*)", r"(?m)^class\s+([A-Za-z_]\w*)", r"(?m)^func\s+(?:\([^)]*\)\s*)?([A-Z]\w*)"]
IDENTIFIER = r"^[A-Za-z_$][\w$]*$"
IMPORT_LINE = r"^\s*(import\b|from\s+\S+\s+import\b|export\s+\{[^}]*\}\s+from\b|export\s+\*\s+from\b|(const|let|var)\s+[\w{}\s,]+=\s*require\()"
CONSTANT_LINE = r"""^(export\s+)?(const|let|var|final|static)?\s*[A-Za-z_$][\w$]*\s*[:=]\s*(['"`][^'"`]*['"`]|-?\d[\d_.]*|true|false|None|null)\s*[,;]?$"""
COMMENT = r"^(//|#|/\*|\*)"
HIT_CHARS = 400


def names_in(text: Column) -> Column:
    """Distinct constants, camel-case names and quoted keys that are not every program's."""
    loud = F.filter(F.regexp_extract_all(text, F.lit(SCREAMING), F.lit(0)), lambda n: F.length(n) >= 5)
    camel = F.filter(F.regexp_extract_all(text, F.lit(CAMEL), F.lit(0)), lambda n: (F.length(n) >= 6) & ~n.isin(COMMON_NAMES))
    keys = F.filter(F.regexp_extract_all(text, F.lit(QUOTED_KEY), F.lit(1)), lambda n: F.length(n).between(3, 40) & ~n.isin(COMMON_KEYS))
    return F.array_distinct(F.concat(loud, camel, keys))


def exported_names(path: Column, text: Column) -> Column:
    """X11: what a file makes available: its own name, exports and top-level definitions."""
    base = F.regexp_replace(P.basename(path), r"\.[^.]+\z", "")
    folder = F.coalesce(F.try_element_at(P.segments(path), F.lit(-2)), F.lit(""))
    own = F.when(base != "index", base).otherwise(folder)
    listed = F.flatten(F.transform(F.regexp_extract_all(text, F.lit(EXPORT_LIST), F.lit(1)), lambda m: F.transform(F.split(m, ","), lambda p: F.trim(F.element_at(F.split(F.trim(p), r"\s+as\s+"), -1)))))
    found = [F.filter(F.array(own), lambda n: n.rlike(IDENTIFIER)), F.regexp_extract_all(text, F.lit(EXPORTS), F.lit(1)), F.filter(listed, lambda n: n.rlike(IDENTIFIER) & (n != "default"))]
    found += [F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in DEFINITIONS]
    return F.filter(F.array_distinct(F.concat(*found)), lambda n: (F.length(n) >= 3) & ~n.isin(COMMON_NAMES))


def _code_lines(text: Column, comment: str) -> Column:
    return F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: (x != "") & ~x.rlike(comment))


def is_registry(text: Column) -> Column:
    """at least eight lines, over 60 % of which assign a constant."""
    lines = _code_lines(text, COMMENT)
    return (F.size(lines) >= 8) & (F.size(F.filter(lines, lambda x: x.rlike(CONSTANT_LINE))) / F.greatest(F.size(lines), F.lit(1)) > 0.6)


def postings(files: DataFrame) -> DataFrame:
    """(repo_id, name, path) of the code files (repo_id, path, category, content)."""
    code = files.filter(F.col("category").isin(C.CODE_CATEGORIES))
    return code.select("repo_id", "path", F.explode(names_in(F.col("content"))).alias("name"))


def rare_names(post: DataFrame, sizes: DataFrame) -> DataFrame:
    """A4: postings of names that two to a few files hold, with holders. sizes: repo_id, n_code.

    The bound prunes before any self-join: a name adds at most 12 * 12 pairs, whatever the corpus's size."""
    post = checkpointed(post)  # read twice, and texts once
    most = F.least(F.lit(12), F.greatest(F.lit(5), F.ceil(F.col("n_code") * 0.03)))
    counted = post.groupBy("repo_id", "name").agg(F.countDistinct("path").alias("holders")).join(sizes, "repo_id")
    return post.join(counted.filter((F.col("holders") >= 2) & (F.col("holders") <= most)).select("repo_id", "name", "holders"), ["repo_id", "name"])


def shared_names(rare: DataFrame) -> DataFrame:
    """(repo_id, path, other, names, weight): files that share rare names, both ways; a rarer name weighs more."""
    other = rare.select("repo_id", "name", F.col("path").alias("other"))
    pairs = rare.join(other, ["repo_id", "name"]).filter("path <> other")
    return pairs.groupBy("repo_id", "path", "other").agg(F.array_sort(F.collect_set("name")).alias("names"), F.sum(F.lit(4.0) / F.col("holders")).alias("weight"))


def positional_index(files: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """(repo_id, path, name, lines): every identifier of a file with the lines, from 0, that hold it and are no import and at
    most HIT_CHARS long; lines is empty where it stands in others only. A whole identifier is a maximal run of letters,
    digits, _ and $ of ASCII. names: repo_id, name of those to index, else all.

    Built once, it answers every question for a name in a file by an equi-join; a text is cut into lines once."""
    held = lambda x, i: F.when((F.length(x) <= HIT_CHARS) & ~x.rlike(IMPORT_LINE), i)
    tokens = lambda x, i: F.transform(F.array_distinct(F.regexp_extract_all(x, F.lit(r"[\w$]+"), F.lit(0))), lambda t: F.struct(t.alias("name"), held(x, i).alias("line")))
    found = files.select("repo_id", "path", F.explode(F.flatten(F.transform(F.split("content", "\n", -1), tokens))).alias("t")).select("repo_id", "path", "t.name", "t.line")
    if names is not None:
        found = found.join(names.select("repo_id", "name").distinct(), ["repo_id", "name"], "left_semi")
    return found.groupBy("repo_id", "path", "name").agg(F.array_sort(F.collect_list("line")).alias("lines"))


def excerpt_pieces(files: DataFrame, wanted: DataFrame, around: int = 2, index: DataFrame | None = None) -> DataFrame:
    """(repo_id, path, key, pieces): the lines of a file that mention one of the names (repo_id, path, key, names), with those
    around them, in order; after a gap the line follows a mark. Imports and lines over HIT_CHARS characters are no hits; a key
    without hits has no row. Names are identifiers, as positional_index has them."""
    asked = wanted.select("repo_id", "path", "key", F.explode("names").alias("name"))
    if index is None:
        index = positional_index(files, asked)
    hits = asked.join(index.filter(F.size("lines") > 0), ["repo_id", "path", "name"]).select("repo_id", "path", "key", F.explode("lines").alias("at"))
    near = hits.select("repo_id", "path", "key", F.explode(F.sequence(F.greatest(F.col("at") - around, F.lit(0)), F.col("at") + around)).alias("line")).distinct()
    held = files.join(hits.select("repo_id", "path").distinct(), ["repo_id", "path"], "left_semi")
    texts = held.select("repo_id", "path", F.posexplode(F.split("content", "\n", -1)).alias("line", "text")).filter(~F.col("text").rlike(IMPORT_LINE))
    rows = near.join(texts, ["repo_id", "path", "line"]).groupBy("repo_id", "path", "key").agg(F.array_sort(F.collect_list(F.struct("line", "text"))).alias("rows"))
    before = F.concat(F.array(F.lit(None).cast("int")), F.transform(F.slice("rows", F.lit(1), F.size("rows") - 1), lambda r: r["line"]))
    pieces = F.zip_with("rows", before, lambda r, b: F.concat(F.when(r["line"] > b + 1, F.lit("…\n")).otherwise(F.lit("")), r["text"]))
    return rows.select("repo_id", "path", "key", pieces.alias("pieces"))


def excerpts(files: DataFrame, wanted: DataFrame, around: int = 2, max_chars: int = 1200) -> DataFrame:
    """(repo_id, path, key, excerpt): the lines of excerpt_pieces that fit, joined; a mark where they do not."""
    # one row for each key of a file that there is, with or without hits
    asked = wanted.filter(F.size("names") > 0).join(files.select("repo_id", "path"), ["repo_id", "path"], "left_semi").select("repo_id", "path", "key")
    pieces = asked.join(excerpt_pieces(files, wanted, around), ["repo_id", "path", "key"], "left").withColumn("pieces", F.coalesce("pieces", F.array().cast("array<string>")))
    # with the sizes so far as the order in which pieces fill the excerpt, those within the bound stay
    sizes = F.transform("pieces", lambda p: F.length(p) + 1)
    n = F.aggregate(
        sizes, F.struct(F.lit(0).alias("size"), F.lit(0).alias("n"), F.lit(False).alias("full")),
        lambda acc, k: F.struct(
            (acc["size"] + k).alias("size"), (acc["n"] + (~acc["full"] & (acc["size"] + k <= max_chars)).cast("int")).alias("n"), (acc["full"] | (acc["size"] + k > max_chars)).alias("full")
        ),
        lambda acc: acc["n"],
    )
    pieces = pieces.withColumn("n", n)
    cut = F.concat(F.slice("pieces", F.lit(1), F.col("n")), F.when(F.col("n") < F.size("pieces"), F.array(F.lit("…"))).otherwise(F.array().cast("array<string>")))
    return pieces.select("repo_id", "path", "key", F.trim(F.array_join(cut, "\n")).alias("excerpt"))


def paired_screens(state_files: DataFrame, screens: DataFrame, edges: DataFrame, rare: DataFrame, reach: DataFrame) -> DataFrame:
    """(repo_id, path, screen): state that belongs to one or two screens follows the strongest; ties to the first reached."""
    importers = edges.select("repo_id", F.col("dst").alias("path"), F.col("src").alias("screen"), F.lit(2).alias("w"))
    names = rare.select("repo_id", "name", "path").join(rare.select("repo_id", "name", F.col("path").alias("screen")), ["repo_id", "name"]).filter("path <> screen").select("repo_id", "path", "screen", F.lit(1).alias("w"))
    weights = importers.unionByName(names).join(screens.select("repo_id", F.col("path").alias("screen")), ["repo_id", "screen"], "left_semi").join(state_files.select("repo_id", "path"), ["repo_id", "path"], "left_semi")
    strong = weights.groupBy("repo_id", "path", "screen").agg(F.sum("w").alias("w")).filter("w >= 2")
    own = Window.partitionBy("repo_id", "path")
    counted = strong.withColumn("n", F.count(F.lit(1)).over(own)).filter("n <= 2").join(reach.select("repo_id", F.col("path").alias("screen"), "reach"), ["repo_id", "screen"], "left")
    first = counted.withColumn("k", F.row_number().over(own.orderBy(F.desc("w"), F.coalesce("reach", F.lit(1_000_000_000)), "screen"))).filter("k = 1")
    return first.select("repo_id", "path", "screen")


def best_siblings(rare: DataFrame, order: DataFrame, least: int = 3, ratio: float = 0.4) -> DataFrame:
    """(repo_id, path, sibling, shared): the earlier file with most names in common, enough of the smaller set.

    order: repo_id, path, ord."""
    sizes = rare.groupBy("repo_id", "path").agg(F.countDistinct("name").alias("n"))
    a = rare.select("repo_id", "name", "path").join(order, ["repo_id", "path"])
    b = a.select("repo_id", "name", F.col("path").alias("sibling"), F.col("ord").alias("ord_b"))
    pairs = a.join(b, ["repo_id", "name"]).filter("ord_b < ord").groupBy("repo_id", "path", "sibling", "ord_b").agg(F.count(F.lit(1)).alias("shared"))
    sized = pairs.join(sizes, ["repo_id", "path"]).join(sizes.select("repo_id", F.col("path").alias("sibling"), F.col("n").alias("n_b")), ["repo_id", "sibling"])
    good = sized.filter((F.col("shared") >= least) & (F.col("shared") >= F.least("n", "n_b") * ratio))
    return good.groupBy("repo_id", "path").agg(F.max_by(F.struct("sibling", "shared"), F.struct("shared", (-F.col("ord_b")).alias("o"))).alias("b")).select("repo_id", "path", "b.sibling", "b.shared")
