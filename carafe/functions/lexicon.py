"""Word lists of the domain."""

# Hints in the order in which they are tried.
COLOURS = ["red", "white", "rose", "rosé", "sparkling", "champagne", "orange"]
VARIETALS = ["sauvignon blanc", "cabernet sauvignon", "cabernet", "pinot noir", "pinot grigio", "riesling", "chardonnay", "syrah", "shiraz", "merlot", "malbec", "champagne", "prosecco"]
REGIONS = ["burgundy", "bordeaux", "sonoma", "napa", "sancerre", "rioja", "tuscany", "champagne", "mosel"]
GEOGRAPHY = ["france", "italy", "spain", "germany", "austria", "oregon", "california", "new york", "australia", "japan", "georgia", "portugal", "argentina", "chile", "new zealand", "south africa", "england", "greece"]
MORE_REGIONS = ["finger lakes", "abruzzo", "friuli", "languedoc", "veneto", "russian river valley", "napa valley", "loire valley", "rhone", "rhône", "beaujolais", "roussillon", "alsace", "piedmont", "sicily", "mendoza", "willamette valley"]
DESCRIPTORS = ["jammy", "earthy", "dark", "fruit", "fruits", "citrus", "aromatic", "tannic", "structured", "refreshing", "crisp", "minerality", "mineral", "peach", "skin", "salty", "dry", "hibiscus", "berry", "berries", "cherry", "watermelon", "tangerine", "herbal", "floral"]
SERVING = ["glass", "glasses", "carafe", "carafes", "bottle", "bottles", "split", "splits"]
NOT_AN_ITEM = ["martini", "draft", "gyokuro", "malt", "cocktail", "beer", "drinks", "rinks", "sold out", "regular price", "sale price", "add to cart", "your cart", "estimated total", "skip to content", "continue shopping", "have an account", "filter and sort", "log in to check"]
OTHER_SECTIONS = ["cocktail", "cocktails", "spirit", "spirits", "beer", "beers", "draft", "whiskey", "whisky", "bourbon", "scotch", "rye", "rum", "tequila", "mezcal", "gin", "vodka", "brandy", "cognac", "negroni", "negronis", "martini", "martinis", "mocktail", "mocktails", "food", "snack", "snacks", "starter", "starters", "appetizer", "appetizers", "entree", "entrees", "main", "mains", "dessert", "desserts", "shellfish", "oyster", "oysters", "seafood", "raw", "cheese", "charcuterie", "cured", "meat", "meats"]
ITEM_SECTIONS = ["red", "white", "orange", "rose", "rosé", "sparkling", "champagne", "sherry", "sake", "sweet", "wine", "wines", "glass", "bottle", "pink"]
SECTION_FILLERS = ["by", "the", "and", "house", "selections", "list", "menu", "our", "wines"]
