"""Names, aliases, patterns and weights that the results depend on. Everything here is data; the logic is elsewhere."""

from __future__ import annotations

#: Fields of a record, in order, and their types.
FIELDS = {
    "lot": "string", "pieces": "int", "meters": "double", "po_number": "string", "net_weight": "double",
    "order_number": "string", "invoice_number": "string", "delivered_date": "string", "quality": "string", "color": "string",
}
#: Fields whose values stand in a document's tables; all others are header fields.
TABLE_FIELDS = ("lot", "pieces", "meters", "net_weight", "color", "quality")
#: How much a source of evidence is trusted with header fields and with table fields.
HEADER_PRIORITY = {"template": 4, "regex": 3, "ai": 2, "table_col": 1}
TABLE_PRIORITY = {"template": 4, "ai": 3, "table_col": 2, "regex": 1}
#: Confidence of a resolved value by its source; sources that aren't named score 0.
SOURCE_CONFIDENCE = {"template": 0.95, "regex": 0.90, "table_col": 0.88, "ai": 0.75}
FLAG_BELOW = 0.85
WEIGHT_TOLERANCE = 0.02
YARDS_PER_METER = 1.09361

#: Column headings that mean a field, in order of precedence.
ALIASES = {
    "pieces": ("Roll No", "Roll Number", "Piece", "Piece No", "Pcs", "No. of Rolls", "Rolls", "PCS", "Pcs.", "No of Pcs", "QTY", "Quantity", "Pieces / Rolls", "Pieces/Rolls", "Pieces / Roll", "No. of Pieces", "No Of Rolls", "Number of Rolls", "Number of Pieces", "Pieces", "pieces / rolls"),
    "meters": ("Qty (MTR)", "Metres", "MTR", "Length (M)", "Quantity (M)", "Qty. in Mtrs", "Total Metres", "Mts", "Mtrs", "MT", "MTR.", "Qty in Mtrs", "Meters", "metres", "Meter", "Length", "Length (Mtr)", "Total Meters", "Total (MTR)", "Qty (Mtr)"),
    "net_weight": ("N Wt.(KGS)", "Net Weight", "Nett Weight", "NW (KG)", "Net Wt", "Net Wt (KG)", "N.Wt.(Kgs)", "Net Wt.(KGS)", "Net Wt. (KGS)", "N. Wt. (KGS)", "Net Weight (KG)", "Net Weight (KGS)", "Nett Wt", "Nett Wt.", "Net W.", "NW"),
    "color": ("Shade", "Colour", "Color", "Shade Name", "Shade Code", "Colour Name", "Colour Code", "Color No", "Colour No", "Shade No.", "Shade No", "Color / Shade", "Color/Shade", "Colour / Shade", "Colour/Shade", "Shade / Color", "Shade/Color", "color / shade"),
    "quality": ("Construction", "Article", "Your product", "Fabric Code", "Quality", "Description", "Item Description", "Fabric Description", "Product Description", "Quality / Article", "Quality/Article", "Article / Quality", "Article/Quality", "Fabric Quality", "Material", "Fabric", "Style", "quality / article"),
    "lot": ("Lot", "Lot No", "Batch", "Batch No", "Lot Number", "Batch Number", "BATCH/LOT", "LOT/BATCH", "Lot / Batch", "Lot/Batch", "Batch / Lot", "Batch/Lot", "Lot No.", "Batch No.", "lot / batch"),
    "invoice_number": ("D/A No", "Invoice No", "Packing List No", "Number", "Commercial Invoice No", "Invoice Number", "Invoice Ref", "Inv No", "Inv.", "Invoice", "PL No", "Packing List Number", "Document No"),
    "order_number": ("Order", "Delivery Nº", "Delivery No", "Order No", "Order Number", "Delivery Note No", "DN No", "Delivery Note", "DO No", "Dispatch Order", "Shipment No", "Delivery Order No"),
    "po_number": ("Contract No", "Your Order", "PO", "PO No", "PO Number", "Customer PO", "Purchase Order", "Order Reference", "Customer Order No", "Customer Order", "Buyer PO", "Buyer's PO", "PO Ref", "Purchase Order No"),
}
#: Aliases that also match as the first or the last word of a heading.
SHORT_ALIASES = ("lot", "mtr", "pcs", "po")

#: Headings that mark a table of single rolls, and one of lots.
ROLL_SIGNATURE = {
    "roll_no": ("roll no", "roll number", "roll#", "roll #", "piece no", "pce no", "piece number", "fabric no", "ref no", "serial no", "sr. no", "item no", "bolt no", "bale no"),
    "length_mts": ("length(mts)", "length (mts)", "length(m)", "length (m)", "meters", "mtr", "qty(mtr)", "qty mtr", "mtrs", "running meters", "rm", "qty (meter)", "quantity (m)", "length in meters"),
    "weight_gross_kgs": ("gross wt", "gross weight", "g.wt", "g wt", "gross", "gw", "weight (gross kgs)", "weight gross", "gross kgs", "gr wt.(kgs)", "gross weight (kg)", "gwt"),
    "weight_nett_kgs": ("net wt", "nett wt", "net weight", "n.wt", "n wt", "nett", "nw", "weight (nett kgs)", "weight nett", "net kgs", "nett kgs", "n wt.(kgs)", "net weight (kg)", "nwt"),
}
LOT_SIGNATURE = {
    "lot": ("lot no", "lot number", "lot#", "lot #", "batch no", "batch", "dye lot", "dyeing lot", "dye batch", "shade lot", "fbn", "fabric batch no"),
    "pieces": ("pieces", "pcs", "rolls", "total rolls", "no. of rolls", "no of pieces", "qty (pcs)", "quantity"),
    "meters": ("total meters", "total mtr", "grand total meters", "sum meters", "meters", "mtr", "qty(mtr)"),
    "net_weight": ("net weight", "nett weight", "total net weight", "net wt", "nett wt", "n.wt.(kgs)", "nw (kg)"),
}
#: Words of a text that speak for single rolls, and for lots.
ROLL_WORDS = ("roll no", "n wt.(kgs)", "gr wt.(kgs)", "gross wt")
LOT_WORDS = ("lot", "piece", "metres", "tone", "lot no")

SUMMARY_WORDS = ("total", "grand total", "net weight total", "summary")
HEADER_WORDS = ("packing list", "invoice", "purchase order", "shipment", "delivery note")
ITEM_WORDS = ("roll no", "lot no", "piece", "metres", "mtr", "qty", "net wt", "shade")
WEIGHT_HEADINGS = ("n wt.(kgs)", "net weight", "nett weight", "nw (kg)", "net wt", "net wt (kg)", "n.wt.(kgs)", "net wt.(kgs)")

#: Patterns of a field in running text, the most specific first; the first group is the value.
PATTERNS = {
    "po_number": (r"(?:PO|Contract\s*No|Your\s*Order|PO\s*No|Customer\s*PO|Client\s*PO)[:\s#]+([A-Z0-9\-\/]{3,30})", r"(?:Customer\s*PO\s*No|Buyer\s*PO)[:\s#]+([A-Z0-9\-]+)"),
    "invoice_number": (r"(?:Invoice\s*No|D\/A\s*No|Packing\s*List\s*No|Commercial\s*Invoice\s*No)[:\s]+([A-Z0-9\.\-\/]{3,30})", r"(?:Inv\.?\s*No|PL\s*No)[:\s]+([A-Z0-9\.\-\/]{3,30})", r"(?:Invoice\s*Ref|Document\s*No)[:\s]+([A-Z0-9\-\/]{3,20})"),
    "delivered_date": (r"(\d{2}[-\/]\w{3,}[-\/]\d{2,4})", r"(\d{2}[\/\.]\d{2}[\/\.]\d{4})", r"(\d{4}-\d{2}-\d{2})", r"Date[:\s]+(\d{2}[-\/]\w{3,}[-\/]\d{2,4})"),
    "net_weight": (r"Net\s*Weight[:\s]+([,\d\.]+)", r"Nett\s*Weight[:\s]+([,\d\.]+)", r"NW\s*\(KG\)[:\s]+([,\d\.]+)", r"N\s*Wt\.\s*\(KGS?\)[:\s]+([,\d\.]+)", r"Total\s*Net\s*(?:Weight|Wt\.?)[:\s]+([,\d\.]+)", r"N\s*Wt\.\s*\(Kgs?\)[:\s]+([,\d\.]+)"),
    "order_number": (r"(?:Order\s*No|Order\s*Number)[:\s#]+([A-Z0-9\/\-]{3,20})", r"(?:Delivery\s*N[oº]|Delivery\s*No|Delivery\s*Note\s*No|DN\s*No)[:\s#]+([A-Z0-9\/\-]{3,20})", r"(?:S\.?O\.?\s*No|Sales\s*Order\s*No)[:\s#]+([A-Z0-9\-]+)", r"(?:Shipment\s*No|Dispatch\s*Order)[:\s#]+([A-Z0-9\-]+)"),
    "lot": (r"(?:Lot\s*No\.?|Batch\s*No\.?|LOT\s*NO\.?|Lot\s*Number)[:\s]+([A-Z0-9\-\/\.]+)", r"(?:^|\s)(?:Lot|Batch)\s*[:\s]+([A-Z0-9\-\/\.]{2,20})", r"Lot\s+([A-Z][A-Z0-9\-\.]*)", r"Batch\s+([A-Z][A-Z0-9\-\.]*)", r"BATCH\/LOT[:\s]+([A-Z0-9\-\/\.]+)", r"Lot\/Batch[:\s]+([A-Z0-9\-\/\.]+)"),
    "quality": (r"(?:Quality|Article|Fabric\s*(?:Code|Description|Quality))[:\s]+([^\n\r]{3,80})", r"(?:Construction|Composition|Your\s*product)[:\s]+([^\n\r]{3,80})", r"(?:Material|Style|Fabric)[:\s]+([^\n\r]{3,80})", r"(?:Description|Item\s*Description)[:\s]+([^\n\r]{3,80})"),
    "color": (r"(?:Colour|Color|Shade)[:\s]+([^\n\r\|]{3,50})", r"Shade\s*(?:Name|Code|No\.?)[:\s]+([^\n\r\|]{3,40})", r"Color\s*\/\s*Shade[:\s]+([^\n\r]{3,40})"),
    "pieces": (r"Total\s*(?:No\.?\s*of\s*)?(?:Rolls?|Pieces?|Pcs?|QTY)[:\s]+(\d+)", r"(?:Grand\s*Total|Total)[:\s\|]+(\d+)\s*(?:Rolls?|Pcs?|Pieces?)", r"No\.\s*of\s*(?:Rolls?|Pieces?|Pcs?)[:\s]+(\d+)", r"Quantity\s*\(?(?:Rolls?|Pcs?)?\)?[:\s]+(\d+)"),
    "meters": (r"Total\s*(?:Metres?|Meters?|MTR|Mtrs?)[:\s]+([,\d\.]+)", r"(?:Grand\s*Total|Total)[:\s\|]+([,\d\.]+)\s*(?:Metres?|Meters?|MTR|Mtrs?|M\b)", r"Qty\s*\(?(?:MTR|Mtrs?|Meters?)?\)?[:\s]+([,\d\.]+)", r"Length\s*\(?(?:M|Mtr)?\)?[:\s]+([,\d\.]+)"),
}
#: Patterns that are tried first for a supplier.
#: Words (lower case) of which every match of a pattern holds one. Patterns that aren't here have none.
PATTERN_WORDS = {
    pattern: words
    for field, every in {
        "po_number": (("po", "contract", "order"), ("customer", "buyer")),
        "invoice_number": (("invoice", "d/a", "list"), ("inv", "pl"), ("ref", "document")),
        "delivered_date": ((), (), (), ("date",)),
        "net_weight": (("weight",), ("nett",), ("nw",), ("wt.",), ("total",), ("wt.",)),
        "order_number": (("order",), ("delivery", "dn"), ("so", "s.o", "sales"), ("shipment", "dispatch")),
        "lot": (("lot", "batch"), ("lot", "batch"), ("lot",), ("batch",), ("batch/lot",), ("lot/batch",)),
        "quality": (("quality", "article", "fabric"), ("construction", "composition", "product"), ("material", "style", "fabric"), ("description",)),
        "color": (("colour", "color", "shade"), ("shade",), ("color",)),
        "pieces": (("total",), ("total",), ("no.",), ("quantity",)),
        "meters": (("total",), ("total",), ("qty",), ("length",)),
    }.items()
    for pattern, words in zip(PATTERNS[field], every, strict=True)
    if words
}
SUPPLIER_PATTERNS = {
    "techs": {"quality": (r"(?:Article)[:\s]+([\w\-\s]+)",), "color": (r"(?:Color|Colour)[:\s]+([\w\-\s]+)",), "lot": (r"(?:Lot\s*No)[:\s]+([\w\-]+)",)},
    "guston": {"po_number": (r"(?:Client\s*PO)[:\s]+([\w\-]+)",), "quality": (r"(?:Style)[:\s]+([\w\-\s]+)",)},
}
LOT_PATTERNS = (r"Lot\s+([A-Z][A-Z0-9\-\.]*)", r"Lot\s*[:\.]?\s*([A-Z][A-Z0-9\-\.]+)", r"Batch\s+([A-Z][A-Z0-9\-\.]*)", r"Batch\s*[:\.]?\s*([A-Z][A-Z0-9\-\.]+)")
LOT_NOT = ("no", "number", "num", "no.", "batch", "lot")
PIECE_PATTERNS = (r"Roll\s+(?:No\.?\s*)?(\d+)", r"Piece\s+(?:No\.?\s*)?(\d+)")
METER_PATTERNS = (r"Total\s+(?:Metres?|Meters?|MTR)[:\s]+([,\d\.]+)", r"([,\d\.]+)\s*(?:Metres?|Meters?|MTR)\s*\(?(?:Total)?\)?")
#: Patterns that find a field's value in the text shown beside it.
SHOWN_PATTERNS = {
    "lot": (r"Lot\s*[:\s]+([A-Z0-9\-\.]+)", r"Batch\s*[:\s]+([A-Z0-9\-\.]+)"),
    "po_number": (r"PO\s*(?:No)?\s*[:\s#]+([A-Z0-9\-\/]+)", r"Contract\s*No\s*[:\s]+([A-Z0-9\-\/]+)"),
    "order_number": (r"Order\s*No\s*[:\s]+([A-Z0-9\/\-]+)", r"Delivery\s*No\s*[:\s]+([A-Z0-9\/\-]+)"),
    "invoice_number": (r"Invoice\s*No\s*[:\s]+([A-Z0-9\.\-\/]+)", r"D\/A\s*No\s*[:\s]+([A-Z0-9\.\-\/]+)"),
    "delivered_date": (r"Date\s*[:\s]+(\d{2}[-\/]\w{3,}[-\/]\d{2,4})",),
    "quality": (r"Quality\s*[:\s]+([^\n\r]+)", r"Article\s*[:\s]+([^\n\r]+)"),
    "color": (r"Color\s*[:\s]+([^\n\r\|]+)", r"Shade\s*[:\s]+([^\n\r\|]+)"),
}
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
#: Exporters' names (a part of them) and their codes.
SUPPLIER_CODES = {"ARTISTIC MILLINERS": "AML", "PENFABRIC": "PEN", "SAPPHIRE": "SFM"}
#: Rows of a roll table that aren't rolls begin so.
SUMMARY_ROW = r"^\s*(sub[\s-]*total|grand\s*total|total|summary)\b"
#: Headings of the known suppliers' roll tables (lower case) and what stands below them.
SUPPLIER_COLUMNS = {
    "AML": {"lot no": "lot", "shade": "color", "shade taper": "color", "roll no": "piece_number", "length(mts)": "meters", "length(yds)": "length_yds", "total points /roll": "points_per_roll", "points / 100m2": "points_per_100m2", "weight (gross kgs)": "weight_gross_kgs", "weight (nett kgs)": "net_weight"},
    "PEN": {"pce no": "piece_number", "dye lot": "lot", "qty(mtr)": "meters", "gross": "weight_gross_kgs", "nett": "net_weight", "design/color": "color"},
    "SFM": {"roll no": "piece_number", "cont. no": "lot", "shade": "color", "grade": "grade", "qty (mtr)": "meters", "qty (yrd)": "length_yds", "n wt. (kgs)": "net_weight", "gr wt. (kgs)": "weight_gross_kgs"},
}
#: Where known suppliers write the values of a document: patterns by field; "last" where totals repeat and the last one counts.
SUPPLIER_HEADERS = {
    "AML": {
        "invoice_number": (r"INVOICE\s+NO\s*[:.]\s*(\S+)", "first"), "delivered_date": (r"DATED\s*[:.]\s*([0-9]{1,2}-[A-Za-z]{3}-[0-9]{2,4})", "first"), "net_weight": (r"TOTAL\s+NET\s+WT\s*[:.]\s*([0-9.,]+)", "last"),
        "meters": (r"TOTAL\s+METERS\s*[:.]\s*([0-9.,]+)", "last"), "pieces": (r"TOTAL\s+ROLLS\s*[:.]\s*([0-9,]+)", "last"), "quality": (r"^\s*([0-9]+%.*\S)\s*$", "first"), "po_number": (r"^\s*PO\s*#\s*([A-Z0-9-]+)", "first"),
    },
    "PEN": {
        "invoice_number": (r"REF\s+No\s*[:.]\s*(\S+)", "first"), "delivered_date": (r"PACKING\s+LIST\s+DATE\s*[:.]\s*(\S+)", "first"), "net_weight": (r"^\s*(?:Sub\s+Total|SUMMARY\s+TOTAL\s+BY\s+COLOUR)\s*:?.*\s([0-9.,]+)\s*$", "last"),
        "meters": (r"^\s*(?:Sub\s+Total|SUMMARY\s+TOTAL\s+BY\s+COLOUR)\s*:?\s*([0-9.,]+)", "last"), "quality": (r"Commodity(?:\s*\(Description\))?\s*:?\s*(\S.*\S)\s*$", "first"), "po_number": (r"PO\s*NO\s*[:.]\s*([A-Z0-9-]+)", "first"),
    },
    "SFM": {
        "invoice_number": (r"Packing\s+List\s+No\.?\s*:?\s*(\S+)", "first"), "delivered_date": (r"\bDate\s*[:.]?\s*([0-9]{1,2}-[A-Za-z]{3}-[0-9]{2,4})", "first"), "net_weight": (r"Net\s+Weight\s*:\s*([0-9.,]+)", "last"),
        "meters": (r"Total\s+Quantity\s*:\s*([0-9.,]+)", "last"), "pieces": (r"^\s*([0-9]+)\s+Total\s*:", "last"), "quality": (r"DESCRIPTION\s+OF\s+GOODS\s*:?\s*(\S.*\S)\s*$", "first"), "po_number": (r"PO#\s*:?\s*([A-Z0-9-]+)", "first"),
    },
}
