"""Given names, titles and units that the text operators know."""

# Common given names by gender and script.
WOMEN = {"latin": ["Anna", "Maria", "Sophie", "Emma", "Laura", "Julia", "Alice", "Claire", "Elena", "Carmen",
                   "Isabel", "Charlotte", "Hannah", "Katharina", "Susanne", "Camille", "Juliette", "Mary", "Sarah",
                   "Jennifer", "Elizabeth", "Linda", "Emily", "Olivia", "Lucia", "Pilar"],
         "cyrillic": ["Анна", "Мария", "Елена", "Ольга", "Наталья", "Ирина", "Татьяна", "Светлана"]}
MEN = {"latin": ["John", "James", "Robert", "Michael", "William", "David", "Thomas", "Peter", "Hans", "Klaus",
                 "Wolfgang", "Pierre", "Jacques", "Antoine", "Olivier", "Carlos", "Miguel", "Javier", "Diego",
                 "Alejandro", "George", "Edward", "Henry", "Stefan", "Matthias", "Bob"],
       "cyrillic": ["Иван", "Дмитрий", "Сергей", "Алексей", "Николай", "Владимир", "Михаил", "Андрей"]}
TITLES = ["Mr", "Mrs", "Ms", "Miss", "Dr", "Prof", "Herr", "Frau", "Monsieur", "Madame", "Mme", "Señor", "Señora", "Sr", "Sra"]
# Units that may follow a number.
UNITS = ["km", "m", "cm", "mm", "mi", "mile", "miles", "meter", "meters", "metre", "metres", "foot", "feet", "ft", "inch",
         "inches", "kg", "g", "mg", "lb", "lbs", "pound", "pounds", "gram", "grams", "ton", "tons", "l", "ml", "liter",
         "liters", "litre", "litres", "gallon", "gallons", "s", "sec", "second", "seconds", "min", "minute", "minutes",
         "h", "hour", "hours", "day", "days", "week", "weeks", "month", "months", "year", "years", "dollar", "dollars",
         "euro", "euros", "cent", "cents", "percent", "degree", "degrees", "hz", "khz", "w", "kw", "v", "n", "j", "pa"]
