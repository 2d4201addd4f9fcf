"""Word lists for fake values. Fixed values; names and countries are our own choice."""

FAKE_EDUCATION = (
    "Bachelors", "Masters", "PhD", "High School", "Diploma", "Associate Degree",
)

FIRST_NAMES = (
    "Alma", "Bruno", "Carla", "Dario", "Elena", "Felix", "Greta", "Hugo", "Irma", "Jonas",
    "Karin", "Luca", "Marta", "Nils", "Olga", "Pablo", "Quinn", "Rosa", "Stefan", "Tilda",
)

LAST_NAMES = (
    "Adler", "Bauer", "Costa", "Dubois", "Eriksen", "Ferrari", "Garcia", "Horvat", "Ivanov",
    "Jensen", "Kowalski", "Lopez", "Moreau", "Novak", "Olsen", "Petrov", "Rossi", "Silva",
    "Toth", "Weber",
)

# Two words and a form make 32 * 32 = 1,024 company names.
COMPANY_WORDS = (
    "Amber", "Birch", "Cedar", "Delta", "Ember", "Falcon", "Garnet", "Harbor", "Indigo",
    "Juniper", "Krypton", "Lumen", "Meadow", "Nimbus", "Onyx", "Prairie", "Quartz", "River",
    "Summit", "Thistle", "Umbra", "Vertex", "Willow", "Xenon", "Yarrow", "Zephyr", "Aurora",
    "Beacon", "Cobalt", "Dune", "Echo", "Fjord",
)

COMPANY_FORMS = (
    "Analytics", "Brothers", "Capital", "Design", "Energy", "Foods", "Group", "Holdings",
    "Industries", "Joinery", "Kitchens", "Labs", "Media", "Networks", "Optics", "Partners",
    "Quarries", "Robotics", "Systems", "Textiles", "Utilities", "Ventures", "Works", "Xpress",
    "Yachts", "Zinc", "Airways", "Books", "Ceramics", "Drones", "Electric", "Freight",
)

COUNTRIES = (
    "Argentina", "Australia", "Austria", "Belgium", "Brazil", "Canada", "Chile", "Colombia",
    "Denmark", "Egypt", "Finland", "France", "Germany", "Ghana", "Greece", "Hungary", "Iceland",
    "India", "Ireland", "Italy", "Japan", "Kenya", "Mexico", "Morocco", "Norway", "Peru",
    "Poland", "Portugal", "Spain", "Sweden", "Thailand", "Vietnam",
)
