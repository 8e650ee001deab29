"""Landed API JSON -> typed tables.

The reference pulls paged JSON from a REST API. Here the pages are landed
files (one envelope ``{"data": ..., "meta": {"pagination": {...}}}`` per
line), read in parallel, parsed once into ``VARIANT`` and decoded with
tolerant per-key fall-backs. Every rule is a Column expression.
Key names and their spellings are fixed values of the API.
"""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from doppel.functions import normalize as N
from doppel.session import ensure_checkpoint_dir
from doppel.sources.scans import items_of, kind as _kind, parse_envelopes, require_complete, scan_status


def _get(v: Column, key: str, typ: str = "variant") -> Column:
    return F.try_variant_get(v, f"$['{key}']", typ)


def flexible_string(v: Column) -> Column:
    """JSON string, trimmed, blank -> null; other types -> null."""
    s = F.when(_kind(v) == "STRING", N.utrim(F.try_variant_get(v, "$", "string")))
    return F.when(s != "", s)


def flexible_bool(v: Column) -> Column:
    """bool; integer != 0; text 1/true/0/false (any case); else null."""
    k = _kind(v)
    text = F.lower(N.utrim(F.try_variant_get(v, "$", "string")))
    return (F.when(k == "BOOLEAN", F.try_variant_get(v, "$", "boolean"))
             .when(k.isin("BIGINT", "INT", "SMALLINT", "TINYINT"), F.try_variant_get(v, "$", "bigint") != 0)
             .when((k == "STRING") & text.isin("1", "true"), F.lit(True))
             .when((k == "STRING") & text.isin("0", "false"), F.lit(False)))


def json_int(v: Column) -> Column:
    """JSON number -> integer (truncated); strings are not accepted."""
    k = _kind(v)
    # whole numbers never pass through a double, which holds 53 bits only
    return (F.when(k.isin("BIGINT", "INT", "SMALLINT", "TINYINT"), F.try_variant_get(v, "$", "bigint"))
             .when(k.startswith("DECIMAL"), F.try_variant_get(v, "$", "decimal(38,9)").try_cast("long"))
             .when(k == "DOUBLE", F.try_variant_get(v, "$", "double").try_cast("long")))


def _first(*cols: Column) -> Column:
    return F.coalesce(*cols)


def _object_date(v: Column) -> Column:
    return F.when(_kind(v).startswith("OBJECT"), flexible_string(_get(v, "date")))


def page_items(envelopes: DataFrame, text_col: str = "value", max_pages: int | None = None,
               check_complete: bool = True, scan_col: str | None = None) -> DataFrame:
    """S1 + S2: envelope text -> one row per item (``scan, page, pos, item`` variant).

    With ``check_complete`` every scan (``scan_col`` tells them apart) must have each of
    its pages once; ``max_pages`` mirrors the API's page cap. See ``scans``.
    """
    parsed = parse_envelopes(envelopes, text_col, scan_col)
    if check_complete:
        require_complete(parsed, max_pages)
    return items_of(parsed)


# The fields of a person that a strict decode types, with their JSON kind.
WHOLE = ("BIGINT", "INT", "SMALLINT", "TINYINT")
STRICT_TEXT = ["firstName", "lastName", "email", "invitationStatus"]
EMAIL_FIELDS = {"email": ("STRING",), "isDefault": ("BOOLEAN",), "contactLabelId": WHOLE}
KIND_NAMES = {("STRING",): "text", ("BOOLEAN",): "a flag", WHOLE: "a whole number"}


def _misfit(v: Column, kinds: tuple[str, ...], name: Column) -> Column:
    """An error text if a present value is of another kind; null stands for nothing."""
    return F.when(~_kind(v).isin("NULL", "VOID", *kinds), F.concat(name, F.lit(f" is not {KIND_NAMES[kinds]}")))


def person_errors(v: Column) -> Column:
    """What a strict decode refuses, as a list of texts; empty for a good record."""
    emails = _get(v, "emails")
    listed = F.try_variant_get(emails, "$", "array<variant>")

    def of_email(e: Column, i: Column) -> Column:
        name = F.concat(F.lit("emails["), i.cast("string"), F.lit("]"))
        is_object = _kind(e).startswith("OBJECT")
        fields = [F.when(is_object, _misfit(_get(e, k), kinds, F.concat(name, F.lit(f".{k}")))) for k, kinds in EMAIL_FIELDS.items()]
        return F.array(F.when(~is_object & ~_kind(e).isin("NULL", "VOID"), F.concat(name, F.lit(" is not an object"))), *fields)

    own = [_misfit(_get(v, "id"), WHOLE, F.lit("id")), *[_misfit(_get(v, k), ("STRING",), F.lit(k)) for k in STRICT_TEXT],
           F.when(~_kind(emails).startswith("ARRAY") & ~_kind(emails).isin("NULL", "VOID"), F.lit("emails is not a list"))]
    in_list = F.when(_kind(emails).startswith("ARRAY"), F.flatten(F.transform(listed, of_email)))
    fields = F.array_compact(F.concat(F.array(*own), F.coalesce(in_list, F.array(F.lit(None).cast("string")))))
    nothing = F.expr("cast(array() as array<string>)")
    return (F.when(_kind(v).isin("NULL", "VOID"), nothing).when(~_kind(v).startswith("OBJECT"), F.array(F.lit("the record is not an object")))
             .otherwise(fields))


def checked_persons(items: DataFrame, item_col: str = "item", keep: tuple[str, ...] = ()) -> DataFrame:
    """S4 in one pass: ``p`` (typed person), ``errors`` and ``item`` text of every item, with the columns ``keep``.

    Nothing is dropped: a record is good (no errors, an id above 0), passed over
    (no errors, no such id; the API's list does the same) or in error, and then no part of it is used.
    """
    errors = person_errors(F.col(item_col))
    made = items.select(*keep, F.col(item_col).alias("item"), errors.alias("errors"))
    return made.select(*keep, F.when(F.size("errors") == 0, _person(F.col("item"))).alias("p"), "errors",
                       F.when(F.size("errors") > 0, F.to_json("item")).alias("item"))


def load_persons(items: DataFrame, item_col: str = "item", strict: bool = True, keep: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """``(persons, quarantine)`` from one written decode; with ``strict`` a record in error raises.

    ``persons``: typed rows with an id above 0. ``quarantine``: ``item, errors``.
    """
    ensure_checkpoint_dir(items.sparkSession)
    checked = checked_persons(items, item_col, keep).checkpoint(eager=True)
    quarantine = checked.where(F.size("errors") > 0).select(*keep, "item", "errors")
    if strict:
        first = quarantine.limit(1).collect()
        if first:
            raise ValueError(f"person parsen: {'; '.join(first[0]['errors'])}: {first[0]['item']}")
    return checked.where("p.person_id > 0").select(*keep, "p.*"), quarantine


def decode_persons(items: DataFrame, item_col: str = "item", keep: tuple[str, ...] = ()) -> DataFrame:
    """S4 + F20-F25: typed rows of the good records only; ``load_persons`` also gives those in error."""
    return checked_persons(items, item_col, keep).where("p.person_id > 0").select(*keep, "p.*")


def invalid_persons(items: DataFrame, item_col: str = "item") -> DataFrame:
    """S4 quarantine: ``item, reason`` of the records in error, and of those without any id (which a strict load passes over)."""
    v = F.col(item_col)
    errors = person_errors(v)
    reason = F.when(F.size(errors) > 0, F.array_join(errors, "; ")).when(~_kind(_get(v, "id")).isin(*WHOLE), F.lit("id is not a whole number"))
    return items.select(F.to_json(v).alias("item"), reason.alias("reason")).where("reason IS NOT NULL")


def _person(v: Column) -> Column:
    addr_keys = ["street", "strasse", "straße", "address"]
    city_keys = ["city", "stadt"]

    def container_field(keys: list[str]) -> Column:
        # first container (homeAddress, home_address, addresses, address) that yields a value;
        # an array container uses its first item with a street or a city
        picks = []
        for ck in ["homeAddress", "home_address", "addresses", "address"]:
            c = _get(v, ck)
            arr = F.when(_kind(c).startswith("ARRAY"), F.try_variant_get(c, "$", "array<variant>"))
            useful = F.filter(arr, lambda it: _addr(it, addr_keys).isNotNull() | _addr(it, city_keys + ["place"]).isNotNull())
            item = F.when(_kind(c).startswith("OBJECT"), c).otherwise(F.try_element_at(useful, F.lit(1)))
            picks.append(_addr(item, keys))
        return F.coalesce(*picks)

    street = _first(*[flexible_string(_get(v, k)) for k in addr_keys], container_field(addr_keys))
    city = _first(*[flexible_string(_get(v, k)) for k in city_keys], container_field(city_keys + ["place"]))
    created = _first(*[flexible_string(_get(v, k)) for k in
                       ["createdAt", "created_at", "createdDate", "creationDate", "creation_date", "cdate"]],
                     *[flexible_string(_get(_get(v, "meta"), k)) for k in
                       ["createdDate", "createdAt", "created_at", "dateCreated", "creationDate"]])
    campus = _get(v, "campus")
    campus_id = _first(*[F.when(json_int(_get(v, k)) > 0, json_int(_get(v, k))) for k in ["campusId", "campus_id"]],
                       F.when(_kind(campus).startswith("OBJECT"), json_int(_get(campus, "id"))))
    consent = []
    for k in ["privacyPolicyAgreement", "privacy_policy_agreement"]:
        c = _get(v, k)
        arr = F.when(_kind(c).startswith("ARRAY"), F.try_variant_get(c, "$", "array<variant>"))
        first_dated = F.try_element_at(F.filter(F.transform(arr, _object_date), lambda d: d.isNotNull()), F.lit(1))
        consent.append(F.when(_kind(c).startswith("OBJECT"), _object_date(c)).otherwise(first_dated))
    emails = F.try_variant_get(v, "$.emails", "array<struct<email string, isDefault boolean, contactLabelId bigint>>")
    return F.struct(
        json_int(_get(v, "id")).alias("person_id"),
        F.coalesce(_get(v, "firstName", "string"), F.lit("")).alias("first_name"),
        F.coalesce(_get(v, "lastName", "string"), F.lit("")).alias("last_name"),
        F.coalesce(_get(v, "email", "string"), F.lit("")).alias("email"),
        emails.alias("emails"),
        F.coalesce(street, F.lit("")).alias("street"),
        F.coalesce(city, F.lit("")).alias("city"),
        F.coalesce(campus_id, F.lit(0)).alias("campus_id"),
        F.coalesce(F.when(_kind(campus).startswith("OBJECT"), N.utrim(_get(campus, "name", "string"))), F.lit(""))
         .alias("campus_name"),
        F.coalesce(N.format_export_date(created), F.lit("")).alias("created_at"),
        F.coalesce(F.when(N.nonblank(_get(v, "invitationStatus", "string")), _get(v, "invitationStatus", "string")),
                   flexible_string(_get(v, "invitation_status")), F.lit("")).alias("invitation_status"),
        _first(flexible_bool(_get(v, "isSystemUser")), flexible_bool(_get(v, "is_system_user"))).alias("is_system_user"),
        _first(flexible_bool(_get(v, "isAllowedToLogin")), flexible_bool(_get(v, "is_allowed_to_login")))
         .alias("is_allowed_to_login"),
        _first(flexible_string(_get(v, "cmsUserId")), flexible_string(_get(v, "cms_user_id"))).alias("cms_user_id"),
        _first(*[F.coalesce(flexible_string(_get(v, k)), _object_date(_get(v, k)))
                 for k in ["acceptedsecurity", "acceptedSecurity", "accepted_security"]]).alias("accepted_security"),
        _first(flexible_string(_get(v, "lastLogin")), flexible_string(_get(v, "last_login"))).alias("last_login"),
        _first(*consent).alias("consent_date"))


def _addr(item: Column, keys: list[str]) -> Column:
    vals = [F.when(_kind(_get(item, k)) == "STRING", N.utrim(_get(item, k, "string"))) for k in keys]
    return F.coalesce(*[F.when(x != "", x) for x in vals])


def id_from_url(url: Column, skip: tuple[str, ...] = ("persons", "person")) -> Column:
    """last ``/`` segment that is a positive integer, skipping collection names."""
    parts = F.reverse(F.split(F.regexp_replace(N.utrim(url), "/+$", ""), "/"))
    kept = F.filter(parts, lambda p: ~N.utrim(p).isin(*skip) & (N.utrim(p) != ""))
    ids = F.filter(F.transform(kept, lambda p: N.utrim(p).try_cast("bigint")), lambda x: x > 0)
    return F.try_element_at(ids, F.lit(1))


def id_from_identifier(text: Column) -> Column:
    """whole text, or its first ``-`` part that is one, as a positive integer."""
    t = N.utrim(text)
    whole = t.try_cast("bigint")
    parts = F.transform(F.split(t, "-"), lambda p: N.utrim(p).try_cast("bigint"))
    return F.when(whole > 0, whole).otherwise(F.try_element_at(F.filter(parts, lambda p: p > 0), F.lit(1)))


def decode_relationships(items: DataFrame, person_id: Column, item_col: str = "item") -> DataFrame:
    """S9 + F26: ``person_id, related_person_id, relationship_type_id, name``; unresolved rows dropped."""
    v = F.col(item_col)
    rtype = _get(v, "relationshipType")
    type_id = _first(*[F.when(json_int(_get(v, k)) > 0, json_int(_get(v, k))) for k in
                       ["relationshipTypeId", "relationTypeId", "relationship_type_id", "relation_type_id"]],
                     F.when(json_int(_get(rtype, "id")) > 0, json_int(_get(rtype, "id"))))
    rel = _get(v, "relative")
    person = _get(v, "person")

    def from_obj(o, identifier: bool):
        ids = [F.when(json_int(_get(o, "id")) > 0, json_int(_get(o, "id"))),
               F.when(json_int(_get(o, "personId")) > 0, json_int(_get(o, "personId"))),
               id_from_url(_get(o, "apiUrl", "string")), id_from_url(_get(o, "frontendUrl", "string"))]
        return _first(*ids, *([id_from_identifier(_get(o, "domainIdentifier", "string"))] if identifier else []))

    related = _first(*[F.when(json_int(_get(v, k)) > 0, json_int(_get(v, k)))
                       for k in ["personId", "relatedPersonId", "relativePersonId"]],
                     from_obj(rel, True), from_obj(person, False))
    own = _get(v, "relationshipName", "string")
    name = N.utrim(F.when(F.coalesce(own, F.lit("")) != "", own).otherwise(_get(v, "degreeOfRelationship", "string")))
    return items.select(person_id.cast("long").alias("person_id"), related.cast("long").alias("related_person_id"),
                        F.coalesce(type_id, F.lit(0)).alias("relationship_type_id"),
                        F.coalesce(name, F.lit("")).alias("name")) \
        .where(F.col("related_person_id").isNotNull())


def decode_groups(items: DataFrame, person_id: Column, item_col: str = "item") -> DataFrame:
    """S8 + F28: a person's groups; nested ``group`` if it has id and name, else the row itself.

    The first record of a group wins: by the column ``pos`` (reading order) if the
    items have one, else by the smallest name, so that the result is defined.
    """
    v = F.col(item_col)

    def read(obj: Column) -> Column:
        gid = _first(F.when(json_int(_get(obj, "groupId")) > 0, json_int(_get(obj, "groupId"))),
                     F.when(json_int(_get(obj, "id")) > 0, json_int(_get(obj, "id"))),
                     id_from_url(_get(obj, "apiUrl", "string"), ("groups",)),
                     id_from_url(_get(obj, "frontendUrl", "string"), ("groups",)))
        name = _first(flexible_string(_get(obj, "name")), flexible_string(_get(obj, "title")),
                      flexible_string(_get(_get(obj, "information"), "name")))
        return F.when((gid > 0) & name.isNotNull(), F.struct(gid.cast("long").alias("group_id"), name.alias("group_name")))

    g = _get(v, "group")
    found = _first(read(F.when(_kind(g).startswith("OBJECT"), g)), read(v))
    order = F.col("pos") if "pos" in items.columns else F.lit(0)
    rows = items.select(person_id.cast("long").alias("person_id"), order.alias("pos"), found.alias("g")).where("g IS NOT NULL")
    return (rows.groupBy("person_id", F.col("g.group_id").alias("group_id"))
            .agg(F.min_by("g.group_name", F.struct("pos", "g.group_name")).alias("group_name")))


def decode_id_names(items: DataFrame, item_col: str = "item", strict: bool = True) -> tuple[DataFrame, DataFrame]:
    """Groups or campuses, ``(rows, quarantine)`` - ``pos, id, name`` and ``item, errors``.

    The id must be a whole number and the name text, either may be missing; ids <= 0 are passed
    over. ``pos`` is kept if the items have it.
    """
    ensure_checkpoint_dir(items.sparkSession)
    v = F.col(item_col)
    empty = _kind(v).isin("NULL", "VOID")
    errors = F.when(empty, F.expr("cast(array() as array<string>)")).when(
        ~_kind(v).startswith("OBJECT"), F.array(F.lit("the record is not an object"))).otherwise(F.array_compact(F.array(
            _misfit(_get(v, "id"), WHOLE, F.lit("id")), _misfit(_get(v, "name"), ("STRING",), F.lit("name")))))
    pos = [F.col("pos")] if "pos" in items.columns else []
    made = items.select(*pos, json_int(_get(v, "id")).alias("id"), F.coalesce(_get(v, "name", "string"), F.lit("")).alias("name"),
                        errors.alias("errors"), F.to_json(v).alias("item")).checkpoint(eager=True)
    quarantine = made.where(F.size("errors") > 0).select("item", "errors")
    if strict:
        first = quarantine.limit(1).collect()
        if first:
            raise ValueError(f"{'; '.join(first[0]['errors'])}: {first[0]['item']}")
    return made.where((F.size("errors") == 0) & (F.col("id") > 0)).drop("errors", "item"), quarantine


def decode_members(items: DataFrame, item_col: str = "item") -> DataFrame:
    """``person_id, first_pos`` of a group's members, each once, at its first place in the scan.

    The id is ``personId`` if that is a number, whatever its value, else ``person.id``; ids
    <= 0 are passed over. ``items`` has the reading order ``pos``.
    """
    v = F.col(item_col)
    own, person = json_int(_get(v, "personId")), _get(v, "person")
    nested = F.when(_kind(person).startswith("OBJECT"), json_int(_get(person, "id")))
    ids = items.select(F.coalesce(own, nested).alias("person_id"), "pos").where("person_id > 0")
    return ids.groupBy("person_id").agg(F.min("pos").alias("first_pos"))


def decode_relationship_types(items: DataFrame, item_col: str = "item") -> DataFrame:
    """``pos, id, name, degree_name_a, degree_name_b, export_title``; anything but text reads as blank, ids <= 0 go."""
    v = F.col(item_col)
    text = {c: F.when(_kind(_get(v, k)) == "STRING", N.utrim(_get(v, k, "string"))) for c, k in
            (("name", "name"), ("degree_name_a", "degreeNameA"), ("degree_name_b", "degreeNameB"), ("export_title", "exportTitle"))}
    return items.select("pos", json_int(_get(v, "id")).alias("id"), *[F.coalesce(t, F.lit("")).alias(c) for c, t in text.items()]).where("id > 0")


def first_filled_source(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Relationship types of the first source, in list order, that can be read and has any.

    A source is a file or folder with an envelope a line. One that can't be opened, has a
    line that is no JSON object or lacks a page is passed over, as is one without types; an
    item that is not an object is an error if its source is reached. What every source has
    is one aggregate over all of them.
    """
    opened = []
    for i, path in enumerate(paths):
        try:
            opened.append(spark.read.text(path).withColumn("scan", F.lit(i)))
        except AnalysisException:  # the path isn't there
            continue
    if not opened:
        raise LookupError("Beziehungstypen konnten nicht geladen werden")
    parsed = parse_envelopes(reduce(DataFrame.unionByName, opened), scan_col="scan")
    items = items_of(parsed)
    found = items.groupBy("scan").agg(F.sum((~_kind(F.col("item")).startswith("OBJECT")).cast("long")).alias("wrong"),
                                      F.sum((json_int(_get(F.col("item"), "id")) > 0).cast("long")).alias("types"))
    usable = scan_status(parsed).where("complete").join(found, "scan").where("wrong > 0 OR types > 0")
    first = usable.select(F.col("scan").cast("int").alias("scan"), "wrong").orderBy("scan").limit(1).collect()
    if not first:
        raise LookupError("Beziehungstypen konnten nicht geladen werden")
    if first[0]["wrong"]:
        raise ValueError(f"{first[0]['wrong']} items of {paths[first[0]['scan']]} are no objects")
    return decode_relationship_types(items.where(F.col("scan") == str(first[0]["scan"])))
