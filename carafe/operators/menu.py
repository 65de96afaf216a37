"""Menu texts to candidate rows.

A document's lines are judged by column expressions, and one fold over them cuts blocks: a block starts at a title line and ends at a
heading, a marker, a line about something else, or text after its price. The fold is needed because whether a line goes on with
a title depends on the title so far. A document is one row from end to end, so nothing is shuffled; a row is as large as its text.

Defined results: null and empty texts have no candidates. Ties can't occur, lines have places. Repeated documents give repeated
candidates. Extra columns of the input are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rows as R
from ..functions.lexicon import REGIONS, VARIETALS
from ..functions.prices import dollars, ends_with_price, inline_price, is_price_line, largest_amount, menu_price, region_price, vintage
from ..functions.quality import ACCEPTED, confidence, notes_quality, text_quality
from ..functions.text import first_hint, let, sanitized_line, section_header, squeeze, without_markers

_TAB, _SECTION = r"^@@TAB:\s*(.+)$", r"^@@SECTION:\s*(.+)$"
_LINE = "struct<line:string,how:struct<kind:string,rest:boolean,varietal:boolean>,more:struct<vintage:int,region:string>,priced:boolean,state:boolean>"
_BLOCK = f"struct<lines:array<{_LINE}>,start:int,amount:double,color:string,tab:string,section:string>"


def split_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc id, line_number, line: every line of every text, sanitized; empty ones too."""
    return docs.select(id_col, F.posexplode(F.split(F.col(text_col).cast("string"), r"\r?\n")).alias("line_number", "line")).withColumn("line", sanitized_line(F.col("line")))


def _judged(line: Column) -> Column:
    def of(known: Column) -> Column:
        kept = F.struct(line.alias("line"), R.continues_title(line, known).alias("how"), known["go"].alias("more"), (ends_with_price(line) | known["priced"]).alias("priced"), R.ends_in_state(line).alias("state"))
        tab, section = (F.when(line.rlike(p), F.trim(F.regexp_extract(line, p, 1))) for p in (_TAB, _SECTION))
        color = section_header(F.coalesce(section, line))
        kind = F.when(line.rlike(_TAB), "tab").when(line.rlike(_SECTION), "section").when(section_header(line).isNotNull(), "header").when(R.is_no_item(line), "other").when(is_price_line(line), "price").otherwise("text")
        heading = F.coalesce(section, squeeze(F.regexp_replace(line, r"[^\p{L}\p{N}\s]", " ")))
        return F.struct(kind.alias("kind"), kept.alias("kept"), tab.alias("tab"), heading.alias("heading"), color.alias("color"), largest_amount(line).alias("amount"), R.is_region_only(line).alias("region_only"), R.row_evidence(line, known).alias("evidence"), R.starts_title(line, known).alias("starts"))
    return let(R.facts(line), of)


def blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per block: doc id, and ``block`` with its judged lines, first line number, price and headings."""
    lines = docs.select(F.col(id_col), F.transform(F.split(F.col(text_col).cast("string"), r"\r?\n"), sanitized_line).alias("_lines"))
    numbered = F.filter(F.transform("_lines", lambda x, i: F.struct(i.alias("at"), x.alias("line"))), lambda x: x["line"] != "")
    lines = lines.select(id_col, numbered.alias("_lines")).withColumn("_seen", F.transform("_lines", lambda x: _judged(x["line"])))
    step = F.transform("_lines", lambda x, i: F.struct(x["at"].alias("at"), F.get(F.col("_seen"), i).alias("is"), F.coalesce(F.get(F.col("_seen"), i + 1)["kind"] == "price", F.lit(False)).alias("price_next")))
    first = F.array_min(F.transform(F.filter("_steps", lambda x: x["is"]["kind"] == "header"), lambda x: x["at"]))
    lines = lines.withColumn("_steps", step).withColumn("_first", F.coalesce(first, F.lit(-1)))

    none, nothing = F.lit(None).cast("string"), F.array().cast(f"array<{_LINE}>")
    state = lambda done, block: F.struct(done.alias("done"), block.alias("block"))
    block = lambda lines, start, amount, color, tab, section: F.struct(lines.alias("lines"), start.cast("int").alias("start"), amount.cast("double").alias("amount"), color.alias("color"), tab.alias("tab"), section.alias("section"))
    open_ = block(nothing, F.lit(0), F.lit(None), none, none, none)
    title = lambda b: F.array_join(F.transform(b["lines"], lambda x: x["line"]), " ")

    def flushed(done: Column, b: Column) -> Column:
        return F.when(F.size(b["lines"]) > 0, F.concat(done, F.array(b))).otherwise(done)

    def fresh(b: Column) -> Column:
        return block(nothing, b["start"], F.lit(None), b["color"], b["tab"], b["section"])

    def advance(s: Column, x: Column) -> Column:
        b, seen = s["block"], x["is"]
        kept, kind, has = F.array(seen["kept"]), seen["kind"], F.size(b["lines"]) > 0
        pushed = block(F.concat(b["lines"], kept), b["start"], b["amount"], b["color"], b["tab"], b["section"])
        begun = block(kept, x["at"], F.lit(None), b["color"], b["tab"], b["section"])
        priced = block(b["lines"], b["start"], F.greatest(b["amount"], seen["amount"]), b["color"], b["tab"], b["section"])
        early = (x["at"] < F.col("_first")) & ~(seen["evidence"] | x["price_next"])
        # after a price only a region goes on with the block, unless it is priced itself
        after = F.when(seen["region_only"] & ~x["price_next"], state(flushed(s["done"], pushed), fresh(b))).when(early, state(flushed(s["done"], b), fresh(b))).otherwise(state(flushed(s["done"], b), begun))
        text = F.when(has & b["amount"].isNotNull(), after).when(~has & early, s).when(~has, state(s["done"], begun))
        text = text.when(seen["starts"] & ~R.goes_on(seen["kept"]["how"], title(b)), state(flushed(s["done"], b), begun)).otherwise(state(s["done"], pushed))
        moved = F.when(kind == "tab", block(nothing, b["start"], F.lit(None), none, seen["tab"], none))
        moved = moved.when(kind.isin("section", "header"), block(nothing, b["start"], F.lit(None), seen["color"], b["tab"], seen["heading"])).otherwise(fresh(b))
        return F.when(kind == "text", text).when(kind == "price", F.when(has, state(s["done"], priced)).otherwise(s)).otherwise(state(flushed(s["done"], b), moved))

    cut = F.aggregate("_steps", state(F.array().cast(f"array<{_BLOCK}>"), open_), advance, lambda s: flushed(s["done"], s["block"]))
    # outer, because the filter that an inner explode implies would be pushed below and fold twice
    return lines.select(id_col, F.explode_outer(cut).alias("block")).where("block is not null")


def candidates_of(cut: DataFrame, as_of_year: int = 2025) -> DataFrame:
    """One candidate per block that is good enough; the other columns of ``cut`` stay in front."""
    names = [c for c in cut.columns if c != "block"]
    lines = F.col("block.lines")

    def title_step(s: Column, x: Column) -> Column:
        last, text = F.element_at(s["lines"], -1), F.array_join(F.transform(s["lines"], lambda t: t["line"]), " ")
        more = ~last["priced"] & ((last["line"].rlike("[-—]$") & x["state"]) | R.goes_on(x["how"], text))
        return F.when(s["over"] | ~more, F.struct(s["lines"].alias("lines"), F.lit(True).alias("over"))).otherwise(F.struct(F.concat(s["lines"], F.array(x)).alias("lines"), F.lit(False).alias("over")))

    begin = F.struct(F.slice(lines, 1, 1).alias("lines"), F.lit(False).alias("over"))
    df = cut.withColumn("_title", F.aggregate(F.slice(lines, 2, F.greatest(F.size(lines), F.lit(1))), begin, title_step, lambda s: s["lines"]))
    df = df.withColumn("_notes", F.slice(lines, F.size("_title") + 1, F.greatest(F.size(lines), F.lit(1)))).withColumn("_title", F.trim(F.array_join(F.transform("_title", lambda x: x["line"]), " ")))
    t = F.col("_title")
    parts = F.filter(F.transform(F.split(t, r"\s*\|\s*"), lambda p: F.trim(p)), lambda p: p != "")
    df = df.withColumn("_pipes", F.when(t.contains("|") & (F.size(parts) >= 2), parts))
    pipes = F.col("_pipes")
    tail = F.when(F.size(pipes) < 3, F.get(pipes, F.lit(1))).otherwise(F.array_join(F.slice(pipes, 3, F.greatest(F.size(pipes), F.lit(1))), ", "))
    df = df.withColumn("_tail", region_price(tail))
    none = lambda c: F.when(c != "", c)
    short = F.size(pipes) < 3
    df = df.withColumn("_pipe_varietal", F.when(~(short & F.col("_tail").isNotNull()), none(without_markers(F.get(pipes, F.lit(1))))))
    df = df.withColumn("_pipe_region", F.coalesce(F.col("_tail.region"), F.when(~short, none(without_markers(tail)))))
    name = F.coalesce(F.get(pipes, F.lit(0)), t)
    df = df.withColumn("_name", name).withColumn("_menu", F.when(pipes.isNull(), menu_price(F.col("_name"))))
    df = df.withColumn("_inline", inline_price(F.regexp_replace(F.coalesce(F.col("_menu.title"), F.col("_name")), r"\s+-\s+", " - ")))
    df = df.withColumn("_text", F.col("_inline.title")).withColumn("_style", R.style_region(F.col("_text"))).withColumn("_year", vintage(F.col("_text"), as_of_year))
    sides = F.split("_text", r"\s+-\s+")
    right = F.trim(F.get(sides, F.lit(1)))
    df = df.withColumn("_right", right).withColumn("_label_right", F.coalesce(F.col("_right").rlike(R.QUOTED) | vintage(F.col("_right"), as_of_year).isNotNull() | first_hint(F.col("_right"), VARIETALS).isNotNull(), F.lit(False)))
    identity = F.when(F.col("_label_right"), F.concat_ws(" ", F.get(sides, F.lit(0)), "_right")).otherwise(F.get(sides, F.lit(0)))
    df = df.withColumn("_who", F.when(F.col("_style").isNotNull(), F.struct(F.lit(None).cast("string").alias("producer"), F.col("_style.style").alias("label"))).otherwise(R.producer_and_label(identity, F.col("_year"))))

    # a varietal and a region on lines of their own, then lines that go on with a year or a region
    note = lambda i: F.get(F.col("_notes"), F.lit(i))["line"]
    df = df.withColumn("_alone", F.when(pipes.isNull(), F.coalesce(R.is_varietal_fragment(note(0)), F.lit(False))).otherwise(F.lit(False)))
    df = df.withColumn("_alone_price", F.when(F.col("_alone"), region_price(note(1))))
    df = df.withColumn("_alone_region", F.when(F.col("_alone"), F.coalesce(F.col("_alone_price.region"), none(without_markers(note(1))))))
    skip = F.when(F.col("_alone"), F.least(F.lit(2), F.size("_notes"))).otherwise(0)
    df = df.withColumn("_rest", F.slice("_notes", skip + 1, F.greatest(F.size("_notes"), F.lit(1))))

    def more_step(s: Column, x: Column) -> Column:
        year, region = x["more"]["vintage"].isNotNull() & s["year"].isNull(), x["more"]["region"].isNotNull() & s["region"].isNull() & F.col("_alone_region").isNull()
        take = ~s["over"] & F.coalesce(year | region, F.lit(False))
        return F.struct((s["n"] + take.cast("int")).alias("n"), F.when(take & year, x["more"]["vintage"]).otherwise(s["year"]).alias("year"), F.when(take & region, x["more"]["region"]).otherwise(s["region"]).alias("region"), (s["over"] | ~take).alias("over"))

    open_ = F.struct(F.lit(0).alias("n"), F.col("_year").alias("year"), F.lit(None).cast("string").alias("region"), (pipes.isNotNull() | F.col("_style").isNotNull()).alias("over"))
    df = df.withColumn("_more", F.aggregate("_rest", open_, more_step))
    text_of = lambda a: F.array_join(F.transform(a, lambda x: x["line"]), " ")
    df = df.withColumn("notes", none(F.trim(text_of(F.slice("_rest", F.col("_more.n") + 1, F.greatest(F.size("_rest"), F.lit(1)))))))
    df = df.withColumn("_varietal", F.coalesce("_pipe_varietal", F.when(F.col("_alone"), note(0))))
    df = df.withColumn("_region", F.coalesce("_style.region", "_pipe_region", "_alone_region", "_more.region", F.when(~F.col("_label_right"), none(F.col("_right")))))
    df = df.withColumn("varietal", F.coalesce(F.lower("_varietal"), first_hint(F.concat_ws(" ", "_text", text_of(F.col("_notes"))), VARIETALS)))
    df = df.withColumn("region", F.coalesce("_region", first_hint(F.col("_text"), REGIONS)))
    df = df.withColumn("price", F.coalesce(dollars(F.col("block.amount")), "_tail.price", "_alone_price.price", "_menu.price", "_inline.price"))
    shown = F.coalesce(F.get(pipes, F.lit(0)), F.col("_text"))
    extra = lambda c: F.when(~R.display_fold(shown).contains(R.display_fold(c)), c)
    df = df.withColumn("raw_text", F.when(F.col("_style").isNotNull(), F.concat_ws(" - ", "_style.style", "_style.region")).otherwise(F.concat_ws(", ", shown, extra(F.col("_varietal")), extra(F.col("_region")))))
    df = df.withColumn("color", F.coalesce("_style.color", "block.color")).withColumn("vintage", F.col("_more.year")).withColumn("producer", F.col("_who.producer")).withColumn("label", F.col("_who.label"))
    df = df.withColumns({"_tq": text_quality(F.col("_text")), "_lq": text_quality(F.col("label")), "_rq": text_quality(F.col("region")), "_nq": notes_quality(F.col("notes"))})
    df = df.withColumn("_sure", confidence(*[F.col(c) for c in ("_tq", "_lq", "_rq", "_nq", "price", "varietal", "color", "vintage")]))
    good = F.col("_title").rlike(r"\p{L}") & ~F.col("_sure.rejected") & (F.col("_sure.confidence") >= ACCEPTED)
    made = F.struct(F.col("block.start").alias("line_number"), "raw_text", "price", F.col("block.tab").alias("menu_tab"), F.col("block.section").alias("menu_section"), "producer", "label", "vintage", "color", "varietal", "region", "notes", F.col("_sure.confidence").alias("extraction_confidence"))
    # an outer explode in place of a filter, which would be pushed below the columns that it reads
    return df.select(*names, F.explode_outer(F.when(good, F.array(made))).alias("_made")).where("_made is not null").select(*names, "_made.*")


def with_candidate_id(candidates: DataFrame, source_col: str = "doc_id") -> DataFrame:
    """A stable id from the source, the line number and the text."""
    return candidates.withColumn("candidate_id", F.sha2(F.concat_ws("|", F.col(source_col).cast("string"), F.col("line_number").cast("string"), "raw_text"), 256))


def parse_menus(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", as_of_year: int = 2025) -> DataFrame:
    """Candidates of menu texts."""
    return with_candidate_id(candidates_of(blocks(docs, id_col, text_col), as_of_year), id_col)


def from_items(items: DataFrame, as_of_year: int = 2025) -> DataFrame:
    """Candidates of structured items: ``name``, ``price``, ``section`` and ``tab``; other columns stay in front."""
    names = [c for c in items.columns if c not in ("name", "price", "section", "tab")]
    line = F.col("name")
    kept = _judged(line)["kept"]
    block = F.struct(F.array(kept).cast(f"array<{_LINE}>").alias("lines"), F.lit(0).alias("start"), F.regexp_extract("price", r"\d+(?:\.\d+)?", 0).try_cast("double").alias("amount"), section_header(F.col("section")).alias("color"), F.col("tab").cast("string").alias("tab"), F.col("section").alias("section"))
    out = candidates_of(items.where("name is not null").select(*names, F.col("price").alias("_price"), block.alias("block")), as_of_year)
    return out.withColumn("price", F.coalesce("_price", "price")).drop("_price")


