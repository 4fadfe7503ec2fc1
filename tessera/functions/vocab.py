"""Words that results must agree on. All tables here are fixed values."""

#: Parts of a category or name, in order, and the type that the first of them gives.
TYPE_RULES = (
    ("engineered marble", "Engineered Marble"), ("engineered glass", "Engineered Glass"), ("engineered stone", "Engineered Stone"),
    ("sintered", "Sintered Stone"), ("neolith", "Sintered Stone"), ("dekton", "Sintered Stone"), ("lapitec", "Sintered Stone"),
    ("laminam", "Sintered Stone"), ("ascale", "Sintered Stone"), ("maximvs", "Sintered Stone"), ("florim", "Sintered Stone"),
    ("infinity", "Sintered Stone"), ("porcelain", "Porcelain"), ("vetrazzo", "Engineered Glass"), ("vetrite", "Engineered Glass"),
    ("nano glass", "Engineered Glass"), ("caesarstone", "Quartz"), ("silestone", "Quartz"), ("compac", "Quartz"), ("santa margherita", "Quartz"),
    ("vicostone", "Quartz"), ("cambria", "Quartz"), ("hanstone", "Quartz"), ("silica free", "Quartz"), ("diresco", "Quartz"),
    ("valiant", "Quartz"), ("revolux", "Quartz"), ("q-luxe", "Quartz"), ("q luxe", "Quartz"), ("q-quartz", "Quartz"), ("qz ", "Quartz"),
    ("viatera", "Quartz"), ("qtz", "Quartz"), ("geoscape", "Porcelain"), ("corian", "Solid Surface"), ("solid surface", "Solid Surface"),
    ("terrazzo", "Terrazzo"), ("terrazo", "Terrazzo"), ("quartzite", "Quartzite"), ("soap stone", "Soapstone"), ("soapstone", "Soapstone"),
    ("dolomite", "Dolomite"), ("dolomites", "Dolomite"), ("dolamite", "Dolomite"), ("calcite", "Calcite"), ("serpentine", "Serpentine"),
    ("serpentinite", "Serpentine"), ("travertine", "Travertine"), ("travertino", "Travertine"), ("trevertine", "Travertine"),
    ("limestone", "Limestone"), ("sandstone", "Sandstone"), ("onyx", "Onyx"), ("slate", "Slate"), ("basalt", "Basalt"), ("schist", "Schist"),
    ("labradorite", "Semi-Precious"), ("sodalite", "Semi-Precious"), ("agate", "Semi-Precious"), ("gemstone", "Semi-Precious"),
    ("crystal", "Semi-Precious"), ("quartz crystal", "Semi-Precious"), ("semi precious", "Semi-Precious"), ("semi-precious", "Semi-Precious"),
    ("precious", "Semi-Precious"), ("glass", "Engineered Glass"), ("marble", "Marble"), ("granite", "Granite"), ("quartz", "Quartz"),
    ("mosaic", "Mosaic"), ("veneer", "Stone Veneer"), ("tile", "Tile"), ("ceramic", "Ceramic"), ("natural stone", "Natural Stone"),
)
GENERIC = ("Ceramic",)
ACCESSORY = "Accessory / Non-Slab"
#: Parts of names of what isn't a slab, and whole words of such names.
ACCESSORY_PARTS = (
    "sink", "faucet", "furniture", "sofa", "lighting", "light fixture", "cleaning", "maintenance", "sealer", "adhesive", "epoxy", "cabinet",
    "wall panel", "hardware", "stainless steel", "kohler", "silgranit", "pvc", "spc tile", "lvt", "cleaning product", "stone care", "sample kit",
    "brochure", "display", "core drill", "drill bit", "razor blade", "steel rod", "polishing pad", "diamond blade", "mesh diamond", "knife grade",
    "brush applicator", "angle grinder", "sample tower", "soap dish", "tape roll", "face mask", "countertop cleaner", "dry treat", "poultice",
    "stain-proof", "stain proof", "kitchen accessor", "cutting board", "colander", "strainer", "tool holder", "toll holder", "wine holder",
    "scratching tool", "dremel", "electroplated", "impregnator", "kleen",
)
ACCESSORY_WORDS = (
    "grit", "velcro", "acetone", "abrasive", "backer", "sanding", "gallon", "makita", "grinder", "cutters", "brushes", "abrax", "workdiamond",
    "handout", "handouts", "cleaner", "gloves", "respirator",
)
#: Equipment for slabs, after the word slab.
SLAB_TOOLS = ("lifter", "rack", "dolly", "cart", "cradle", "a-?frame", "trolley", "clamp", "buggy", "trailer", "lifting", "handling", "storage", "hook", "caddy", "stand")
#: Finish words and what they are reported as.
FINISHES = {
    "polished": "Polished", "polish": "Polished", "honed": "Honed", "leathered": "Leathered", "leather": "Leathered", "brushed": "Brushed",
    "flamed": "Flamed", "matte": "Matte", "matt": "Matte", "satin": "Satin", "caressed": "Caressed", "suede": "Suede",
}
FINISH_EMPTY = ("unspecified", "n/a", "na", "none", "-", "--")
#: Colours in names, longer ones first.
COLORS = (
    "off white", "off-white", "light blue", "dark blue", "royal blue", "navy blue", "sea green", "light green", "dark green", "light gray", "dark gray",
    "light grey", "dark grey", "rose gold", "white", "black", "beige", "gray", "grey", "blue", "brown", "cream", "green", "gold", "ivory", "red", "pink",
    "silver", "yellow", "taupe", "purple", "aqua", "terracotta", "burgundy", "bronze", "copper", "charcoal", "tan", "navy", "maroon", "emerald",
    "turquoise", "teal", "orange", "honey", "mocha", "walnut", "cognac", "champagne",
)
#: Colour families and the words that belong to them.
FAMILIES = {
    "White": ("white",), "Black": ("black",), "Gray": ("gray", "grey"), "Blue": ("blue",), "Beige": ("beige",), "Brown": ("brown",),
    "Gold": ("gold", "golden"), "Cream": ("cream", "ivory"), "Green": ("green",), "Silver": ("silver",), "Tan": ("tan",),
    "Multi": ("multi", "multicolor", "multicolour"), "Yellow": ("yellow",), "Red": ("red",), "Taupe": ("taupe",), "Pink": ("pink",),
    "Orange": ("orange",), "Purple": ("purple", "violet", "lavender"), "Bronze": ("bronze",), "Charcoal": ("charcoal",),
}
#: Centimetres of a unit; nominal thicknesses in centimetres.
UNIT_CM = {"cm": 1.0, "mm": 0.1, "in": 2.54, "inch": 2.54}
NOMINAL_CM = (0.4, 0.6, 0.8, 1.0, 1.2, 1.5, 1.6, 2.0, 3.0, 4.0, 5.0, 6.0)
#: Prices by the square foot, and bare ones.
PRICE_BY_AREA = r"(?i)\$\s*([\d,]+(?:\.\d+)?)\s*/\s*(?:sf|sq\.?\s*ft)"
PRICE_BARE = r"^\$\s*([\d,]+(?:\.\d+)?)$"
#: What a name's key leaves out, in this order: remarks, finishes, qualifiers, sizes, units; and words of form.
KEY_REMARK = r"\([^)]*\)"
KEY_FINISH = r"\b(?:un)?(?:honed|leather(?:ed)?|polished|brushed|flamed|matte|satin|caressed|suede|velvet|antique[d]?|dual)(?=\d|\b)"
KEY_QUALIFIER = r"\b(?:\d+(?:\.\d+)?\s*cm|\(?\s*l\s*(?:&|x|and)\s*r\s*\)?|sj)\b"
KEY_SIZE = r"\b\d+(?:\.\d+)?\s*[x×]\s*\d+(?:\.\d+)?(?:\s*[x×]\s*\d+(?:\.\d+)?)*\b"
KEY_UNIT = r"\b\d+(?:\.\d+)?\s*(?:mm|in|inch|inches)\b"
KEY_FORM = r"\b(?:slabs?|finish)\b"
#: Spellings in queries and those that suppliers use, in the order in which they are tried.
SPELLINGS = {
    "calcutta": "calacatta", "calacata": "calacatta", "calactta": "calacatta", "calacutta": "calacatta", "calcatta": "calacatta", "calacatt": "calacatta",
    "carrera": "carrara", "carara": "carrara", "cararra": "carrara", "carrarra": "carrara", "statuary": "statuario", "statuarrio": "statuario", "stautario": "statuario",
    "taj": "taj mahal", "tajmahal": "taj mahal", "cambrian": "cambria", "silstone": "silestone", "ceasarstone": "caesarstone", "quartzsite": "quartzite",
    "quartsite": "quartzite", "travertino": "travertine", "travertin": "travertine", "blue de savoie": "bleu de savoie", "cremarfil": "crema marfil",
    "marquinia": "marquina", "marqunia": "marquina", "thasos": "thassos", "thassoss": "thassos", "imperador": "emperador", "bottocino": "botticino", "botocino": "botticino",
}
#: Types that a query names, in the order in which they are looked for.
QUERY_TYPES = (
    ("soap stone", "Soapstone"), ("sintered stone", "Sintered Stone"), ("semi precious", "Semi-Precious"), ("semi-precious", "Semi-Precious"), ("solid surface", "Solid Surface"),
    ("engineered marble", "Engineered Marble"), ("engineered glass", "Engineered Glass"), ("engineered stone", "Engineered Stone"), ("natural stone", "Natural Stone"),
    ("stone veneer", "Stone Veneer"), ("quartzite", "Quartzite"), ("granite", "Granite"), ("marble", "Marble"), ("quartz", "Quartz"), ("porcelain", "Porcelain"),
    ("dolomite", "Dolomite"), ("travertine", "Travertine"), ("onyx", "Onyx"), ("limestone", "Limestone"), ("soapstone", "Soapstone"), ("slate", "Slate"), ("basalt", "Basalt"),
    ("sandstone", "Sandstone"), ("schist", "Schist"), ("terrazzo", "Terrazzo"), ("mosaic", "Mosaic"), ("sintered", "Sintered Stone"), ("neolith", "Sintered Stone"),
    ("dekton", "Sintered Stone"), ("lapitec", "Sintered Stone"), ("caesarstone", "Quartz"), ("silestone", "Quartz"), ("engineered", "Engineered Stone"),
    ("veneer", "Stone Veneer"), ("precious", "Semi-Precious"), ("porcelin", "Porcelain"),
)
#: Finishes that a query names; they stay terms.
QUERY_FINISHES = (
    "polished", "honed", "leathered", "leather", "brushed", "matte", "matt", "satin", "flamed", "caressed", "suede", "velvet", "antiqued", "antique",
    "tumbled", "sandblasted", "bushhammered", "glossy", "textured",
)
#: Words of a query that say nothing about a product.
STOP = (
    "the", "a", "an", "of", "in", "on", "with", "and", "or", "for", "me", "show", "find", "get", "want", "need", "looking", "look", "please", "material", "materials", "stone", "stones",
    "color", "colour", "colored", "coloured", "some", "any", "type", "types", "all", "that", "are", "is", "to",
)
#: Forms that a query names.
FORMS = {"slab": "slab", "slabs": "slab", "tile": "tile", "tiles": "tile", "remnant": "remnant", "remnants": "remnant", "remmnant": "remnant"}
#: The width in a photo's address as it is stored, and the widest.
STORED_WIDTH = ("width=1400", "width=2400")
#: The end of hosts whose origins are geological.
GEOLOGICAL = ".iblocky.it"
#: Types and origins in one feed's language, and words of types that say nothing.
FEED_TYPES = {
    "marmo": "Marble", "marmi": "Marble", "marbles": "Marble", "granito": "Granite", "graniti": "Granite", "granites": "Granite", "quarzite": "Quartzite", "onice": "Onyx",
    "travertino": "Travertine", "travertines": "Travertine", "arenaria": "Sandstone", "calcare": "Limestone", "semiprezioso": "Semi-Precious",
    "materiali semipreziosi": "Semi-Precious", "ceramica": "Ceramic", "agglomerato": "Agglomerate", "agglomerato marmo": "Agglomerate",
}
FEED_NO_TYPE = ("n/a", "na", "sicily", "pietra", "altre pietre", "altro", "other", "-")
FEED_ORIGINS = {
    "italy": "Italy", "italia": "Italy", "brazil": "Brazil", "brasile": "Brazil", "india": "India", "greece": "Greece", "grecia": "Greece", "angola": "Angola",
    "portugal": "Portugal", "portogallo": "Portugal", "turkey": "Turkey", "turchia": "Turkey", "norway": "Norway", "norvegia": "Norway", "zimbabwe": "Zimbabwe", "iran": "Iran",
    "tunisia": "Tunisia", "namibia": "Namibia", "spain": "Spain", "spagna": "Spain", "albania": "Albania", "china": "China", "cina": "China", "morocco": "Morocco",
    "marocco": "Morocco", "croatia": "Croatia", "croazia": "Croatia", "egypt": "Egypt", "egitto": "Egypt", "france": "France", "francia": "France",
    "switzerland": "Switzerland", "svizzera": "Switzerland", "south africa": "South Africa", "sudafrica": "South Africa", "vietnam": "Vietnam", "andorra": "Andorra",
}
#: Types that a feed's group names may have in them.
GROUP_TYPES = r"(?i)(quartzite|granite|marble|quartz|porcelain|dolomite|onyx|travertine|limestone|soapstone|slate|sintered)"
#: Words of texts about stone.
STONE_WORDS = r"(?i)granite|quartzite|marble|limestone|dolomit|soapstone|onyx|travertine|gneiss|schist|slate|basalt|sandstone|quarr"


#: A slab's size in inches in one provider's feed, and the id of a listing in another's sitemap.
SLAB_SIZE = r"([\d.]+)\s*''?\s*x\s*([\d.]+)"
LISTING_ID = r"/listings/([0-9a-zA-Z_-]+)"
#: Fixed value: an address in a sitemap.
SITEMAP_LOC = r"(?i)<loc>\s*([^<]+?)\s*</loc>"
