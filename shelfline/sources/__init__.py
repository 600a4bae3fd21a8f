from shelfline.sources.tables import CsvTables, RetailTables, TableRegistry  # noqa: F401
from shelfline.sources.testbed import ParquetTestbed  # noqa: F401
from shelfline.sources.stored_tables import StoredTables, kept_tables  # noqa: F401
