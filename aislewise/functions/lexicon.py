"""Word lists are data.  These short defaults can be replaced list by list."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Lexicon:
    product_words: tuple[str, ...] = ("mjölk", "bröd", "ost", "smör", "ägg", "kaffe", "juice", "pasta", "ris", "mjöl",
                                      "lök", "tomat", "banan", "kyckling", "lax", "glass")
    brands: tuple[str, ...] = ("arla", "felix", "pågen", "fazer", "findus", "heinz")
    attributes: tuple[str, ...] = ("röd", "grön", "gul", "vit", "stor", "liten", "eko", "ekologisk", "vegan", "mild")
    non_food: tuple[str, ...] = ("tillbehör", "porslin", "rengöring", "tvätt", "schampo", "bestick")
    exclusions: dict[str, tuple[str, ...]] = field(
        default_factory=lambda: {"mjölk": ("mjölkfri",), "gluten": ("glutenfri",), "socker": ("sockerfri",)}
    )
    primary: dict[str, tuple[str, ...]] = field(
        default_factory=lambda: {"mjölk": ("standardmjölk", "mellanmjölk", "lättmjölk"), "ost": ("hårdost", "cheddar")}
    )
    secondary: dict[str, tuple[str, ...]] = field(
        default_factory=lambda: {"mjölk": ("kondenserad", "kokos", "havre", "choklad"), "ost": ("färsk", "kvarg")}
    )
    specific: tuple[str, ...] = ("kokos", "kondenserad", "havre", "soja")
    common_sizes: tuple[str, ...] = ("1l", "1,5l", "1.5l", "2l", "500g", "1kg", "400g", "500ml")
    synonyms: dict[str, tuple[str, ...]] = field(
        default_factory=lambda: {"pasta": ("spaghetti", "penne", "makaroner"), "fisk": ("lax", "torsk", "sill")}
    )
    concepts: dict[str, tuple[str, ...]] = field(
        default_factory=lambda: {"frukost": ("yoghurt", "bröd", "ägg"), "fika": ("bulle", "kaffe", "kaka")}
    )
    whole_words: tuple[str, ...] = ("ris", "öl", "te", "ost", "fil")
    routing: tuple[str, ...] = ("recept", "middag", "vad ska", "förslag", "billig")
    states: tuple[str, ...] = ("färsk", "färska", "torkad", "torkade", "fryst", "kokt", "hel", "mald", "riven", "rökt")
    pantry: tuple[str, ...] = ("salt", "peppar", "vatten", "olja", "socker")
    not_food: tuple[str, ...] = ("smörpapper", "grillspett", "folie")
    non_food_departments: tuple[str, ...] = ("Apotek", "Djur", "Kök", "Tobak")
    organic: tuple[str, ...] = ("ekologisk", "krav")
    derived_forms: tuple[str, ...] = ("kaka", "juice", "soppa", "sås", "glass", "godis", "chips", "saft", "inlagd")
    derived_categories: tuple[str, ...] = ("glass", "godis", "läsk", "barnmat", "färdig", "marmelad", "nudlar")
    meat_fish: tuple[str, ...] = ("kött", "fläsk", "nöt", "kyckling", "korv", "skinka", "bacon", "fisk", "lax", "räk")
    animal: tuple[str, ...] = ("kött", "fläsk", "nöt", "kyckling", "korv", "skinka", "bacon", "fisk", "lax", "räk",
                               "ägg", "mjölk", "grädde", "smör", "yoghurt", "honung")
    embedded_fish: tuple[str, ...] = ("sill", "räkor", "lax")
    english_meat: tuple[str, ...] = ("chicken", "beef", "pork", "bacon")
    staple_categories: tuple[str, ...] = ("pasta", "fläsk", "nötkött", "kyckling", "fisk", "lax", "korv")
    drinks: tuple[str, ...] = ("vodka", "whisky", "likör", "tonic", "lemonad", "prosecco")
    non_meal: tuple[str, ...] = ("efterrätt", "dessert", "bakverk", "fika", "dryck", "tillbehör", "godis")
    non_meal_endings: tuple[str, ...] = ("dressing", "glass", "kaka", "sås", "sylt", "smoothie")
    beauty: tuple[str, ...] = ("ansiktsmask", "tvål", "schampo")
    protein_sources: tuple[tuple[str, tuple[str, ...], bool], ...] = (
        ("fågel", ("kyckling", "anka", "höns"), True),
        ("kött", ("biff", "kalv", "gris", "bacon"), False),
        ("fisk", ("lax", "torsk", "gös", "fisk"), False),
        ("växter", ("linser", "tofu", "kidneybönor"), False),
        ("mejeri", ("halloumi", "mozzarella"), False),
    )
    label_noise: tuple[str, ...] = ("kr/kg", "jämförpris", "medlemspris", "pant", "unreadable", "no text")
    # Ingredient lines: what follows a purpose word goes; empty words and asides name no product; either parts
    # alternatives, and such_as opens a list of them.
    purpose_words: tuple[str, ...] = ("till", "inför")
    empty_words: tuple[str, ...] = ("ca", "omkring", "helst", "burk", "burkar", "flaska", "flaskor", "kartong", "näve")
    asides: tuple[str, ...] = ("utan skal", "i tärningar")
    either: tuple[str, ...] = ("eller", "respektive")
    such_as: tuple[str, ...] = ("exempelvis", "såsom")
    # What a diet rules out: terms at the start of a word, terms anywhere, phrases that are cut out of the text
    # before looking, and terms that another word in the text excuses.
    imitations: tuple[str, ...] = ("vegansk", "växtbaserad", "växtbaserat")
    imitation_words: tuple[str, ...] = ("vegan", "vego")
    dairy_inside: tuple[str, ...] = ("ost",)
    dairy_lookalikes: tuple[str, ...] = ("rost",)
    excused: tuple[tuple[str, str], ...] = ()
