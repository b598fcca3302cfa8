"""Provider answers in JSON as candidates: provider, identifier, title, authors, year, venue, doi, url. Broken or missing answers give empty fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from refmill.functions.text import bounded_year, collapse, doi_in, extract_year, first_of, normalize_doi, repair_identifiers, resolve

_DATE = "struct<`date-parts`:array<array<int>>>"
CROSSREF = f"struct<DOI:string,URL:string,title:string,`container-title`:string,author:array<struct<family:string,given:string>>,`published-print`:{_DATE},`published-online`:{_DATE},issued:{_DATE}>"
OPENALEX = "struct<id:string,doi:string,display_name:string,title:string,publication_year:string,authorships:array<struct<author:struct<display_name:string>>>,primary_location:struct<landing_page_url:string,source:struct<display_name:string>>>"
PUBMED = "struct<title:string,authors:array<struct<name:string>>,pubdate:string,fulljournalname:string,elocationid:string,articleids:array<struct<idtype:string,value:string>>>"


def _clean(c: Column) -> Column:
    return collapse(resolve(c))


def _head(c: Column) -> Column:
    """The first of a list given as JSON text, or the text itself."""
    return F.when(c.startswith("["), F.coalesce(F.get_json_object(c, "$[0]"), F.lit(""))).otherwise(F.coalesce(c, F.lit("")))


def _names(list_: Column) -> Column:
    """Cleaned names that aren't empty; cleaned as one text, a mark between them."""
    joined = resolve(F.coalesce(F.array_join(list_, "\x01"), F.lit("")))
    return F.filter(F.transform(F.split(joined, "\x01"), collapse), lambda x: x != "")


def _year(item: str) -> Column:
    parts = [F.get(F.get(F.col(f"{item}.`{k}`.`date-parts`"), F.lit(0)), F.lit(0)) for k in ("published-print", "published-online", "issued")]
    return F.coalesce(*parts)


def from_crossref(rows: DataFrame, keep: list[str], payload: str) -> DataFrame:
    rows = rows.select(*keep, F.from_json(payload, CROSSREF).alias("j"))
    name = F.transform(F.coalesce("j.author", F.array().cast("array<struct<family:string,given:string>>")), lambda a: F.concat_ws(", ", F.nullif(F.trim(a["family"]), F.lit("")), F.nullif(F.trim(a["given"]), F.lit(""))))
    rows = rows.withColumns({"doi": F.lower(_clean(F.col("j.DOI"))), "link_": _clean(F.col("j.URL")), "title": _clean(_head(F.col("j.title"))), "venue": _clean(_head(F.col("j.`container-title`"))), "authors": _names(name), "year": _year("j")})
    url = first_of(F.col("link_"), F.when(F.col("doi") != "", F.concat(F.lit("https://doi.org/"), "doi")))
    return rows.select(*keep, F.lit("crossref").alias("provider"), first_of(F.col("doi"), F.col("link_")).alias("identifier"), "title", "authors", "year", "venue", "doi", url.alias("url"))


def from_openalex(rows: DataFrame, keep: list[str], payload: str) -> DataFrame:
    rows = rows.select(*keep, F.from_json(payload, OPENALEX).alias("j"))
    name = F.transform(F.coalesce("j.authorships", F.array().cast("array<struct<author:struct<display_name:string>>>")), lambda a: F.coalesce(a["author"]["display_name"], F.lit("")))
    rows = rows.withColumns({"doi": normalize_doi(F.col("j.doi")), "id_": _clean(F.col("j.id")), "title": _clean(first_of(F.col("j.display_name"), F.col("j.title"))), "venue": _clean(F.col("j.primary_location.source.display_name")), "authors": _names(name), "year": bounded_year(F.col("j.publication_year")), "page_": _clean(F.col("j.primary_location.landing_page_url"))})
    return rows.select(*keep, F.lit("openalex").alias("provider"), first_of(F.col("id_"), F.col("doi")).alias("identifier"), "title", "authors", "year", "venue", "doi", first_of(F.col("page_"), F.col("id_")).alias("url"))


def from_pubmed(rows: DataFrame, keep: list[str], pmid: str, payload: str) -> DataFrame:
    rows = rows.select(*keep, F.col(pmid).cast("string").alias("identifier"), F.from_json(payload, PUBMED).alias("j"))
    own = F.get(F.filter("j.articleids", lambda a: a["idtype"] == "doi"), F.lit(0))["value"]
    name = F.transform(F.coalesce("j.authors", F.array().cast("array<struct<name:string>>")), lambda a: F.coalesce(a["name"], F.lit("")))
    rows = rows.withColumns({"own_": F.lower(_clean(own)), "title": F.rtrim(_clean(F.col("j.title")), F.lit(".")), "venue": _clean(F.col("j.fulljournalname")), "authors": _names(name), "year": extract_year(F.col("j.pubdate")), "place_": repair_identifiers(F.col("j.elocationid"))})
    return rows.select(*keep, F.lit("pubmed").alias("provider"), "identifier", "title", "authors", "year", "venue", first_of(F.col("own_"), doi_in(F.col("place_"))).alias("doi"), F.concat(F.lit("https://pubmed.ncbi.nlm.nih.gov/"), "identifier", F.lit("/")).alias("url"))


def pubmed_term(title: Column, raw: Column, surname: Column) -> Column:
    """What is asked of an index of titles and authors."""
    return F.concat(F.lit('"'), first_of(title, raw), F.lit('"[Title]'), F.when(surname != "", F.concat(F.lit(" AND "), surname, F.lit("[Author]"))).otherwise(F.lit("")))
