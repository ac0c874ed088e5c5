"""Reading the records of collections from files, with their guards."""
